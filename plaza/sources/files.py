"""Reading crawler files of several formats, finding and comparing them, and writing them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plaza.functions import scalar as S
from plaza.functions.digest import set_digest
from plaza.sources.paths import staged
from plaza.sources.stores import upsert_table

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_QUOTES = {'"': "&quot;"}
KINDS = ("author", "content", "comment")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON-lines files, and the bad lines as (path, line, message).

    Each line keeps its file and a number that grows with its place in the file (last wins by it); blank lines and a leading
    byte-order mark are skipped.
    Without a schema the objects stay VARIANT values.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("_raw"))
    numbered = raw.where(F.trim("_raw") != "")
    value = F.try_parse_json("_raw")
    ok = value.isNotNull() & F.startswith(F.ltrim("_raw"), F.lit("{"))
    bad = numbered.where(~ok).select(F.col("_path").alias("path"), F.col("_at").alias("line"), F.when(value.isNull(), "not JSON").otherwise("not an object").alias("message"))
    good = numbered.where(ok)
    if schema is None:
        return good.select(value.alias("record"), F.col("_path").alias("path"), F.col("_at").alias("line")), bad
    return good.select(F.from_json("_raw", schema).alias("_r"), "_path", "_at", "_raw").select("_r.*", F.col("_path").alias("path"), F.col("_at").alias("line"), F.col("_raw").alias("raw_payload")), bad


def read_json_file(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that hold one array of objects or one object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Files with a header; all values are text, and quotes may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


_XLSX = "path string, sheet string, row int, record map<string,string>"


def _sheet_rows(z: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[dict[int, str]]:
    for _, e in ElementTree.iterparse(z.open(name)):
        if not e.tag.endswith("}row"):
            continue
        row: dict[int, str] = {}
        for k, c in enumerate(x for x in e if x.tag.endswith("}c")):
            ref = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(ref[0]))) - 1 if ref else k
            value = next((x.text for x in c if x.tag.endswith("}v")), None)
            if c.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(x.text or "" for x in c.iter() if x.tag.endswith("}t"))
            if value is not None:
                row[at] = value
        e.clear()
        yield row


def _workbooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            out = []
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in names else []
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
                for s in (x for x in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter() if x.tag.endswith("}sheet")):
                    target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
                    rows = _sheet_rows(z, target if target.startswith("xl/") else f"xl/{target}", shared)
                    header = next(rows, {})
                    for n, row in enumerate(rows, 2):
                        record = {header[k]: v for k, v in row.items() if header.get(k, "").strip() and v.strip()}
                        if record:
                            out.append((path, s.get("name"), n, record))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "record"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, record) of workbooks, one task a file; blank rows and unnamed columns are skipped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInPandas(_workbooks, _XLSX)


def kind_of(name: Column) -> Column:
    """The entity kind that a file name tells, or null."""
    n = F.lower(name)
    return F.when(n.contains("comment"), "comment").when(n.rlike("content|aweme|video"), "content").when(n.rlike("creator|author"), "author")


def kind_of_record(record: Column) -> Column:
    """The entity kind that the keys of a record tell."""
    has = lambda k: F.array_contains(F.json_object_keys(record), k)
    return F.when(has("comment_id"), "comment").when(has("aweme_id") | has("video_id") | has("note_id"), "content").when(has("user_id"), "author")


def catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size, modified, format, kind) of the files below a folder, newest first; only metadata is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    order = F.when(kind_of(name) == "author", 0).when(kind_of(name) == "content", 1).otherwise(2)
    x = f.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("format"), kind_of(name).alias("kind"), order.alias("kind_order"))
    return x.orderBy(F.desc("modified"), "path")


def catalog_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("format", "kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def run_id(prints: DataFrame, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """(run_id): a version-5 UUID of the sorted parameters (platform, query and so on; none that are null) and the digest of the files' fingerprints, in whatever order they are read."""
    told = "&".join(f"{k}={v}" for k, v in sorted((parameters or {}).items()) if v is not None)
    one = set_digest(prints, [], F.col("sha256")).agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("files"))
    return one.select(S.uuid5(F.concat(F.lit(f"plaza:ingest:{told}:"), "files")).alias("run_id"))


def latest_batch(files: DataFrame, seconds: int = 300) -> DataFrame:
    """The newest file and its siblings: same folder, format, first name token and last; or else all of the last ``seconds``."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    token = F.concat_ws("|", folder, "format", F.regexp_extract("name", "^([^_]*)_", 1), F.regexp_extract("name", r"_([^_.]*)\.[^.]*$", 1))
    x = files.withColumn("_token", token)
    newest = x.agg(F.max(F.struct("modified", "path", "_token")).alias("n")).select("n.modified", F.col("n._token").alias("_newest")).withColumnRenamed("modified", "_last")
    y = x.join(F.broadcast(newest))  # one row
    named = F.regexp_extract("name", r"_([^_.]*)\.[^.]*$", 1) != ""
    same, near = (F.col("_token") == F.col("_newest")) & named, F.col("modified").cast("double") >= F.col("_last").cast("double") - seconds
    some = F.max(same.cast("int")).over(Window.partitionBy(F.lit(0)))  # file names: a catalog, not data
    return y.withColumn("_some", some).where(F.when(F.col("_some") == 1, same).otherwise(near)).select(*files.columns)


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are new or differ in time or size."""
    return now.join(before.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


# Sinks --------------------------------------------------------------------------------------------------------------------------


def flat_values(df: DataFrame) -> DataFrame:
    """Nested values as JSON text and nulls as empty text: for files that hold text only."""
    shape = lambda f: F.to_json(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f.name).cast("string")
    return df.select(*[F.coalesce(shape(f), F.lit("")).alias(f.name) for f in df.schema])


def append(df: DataFrame, path: str, fmt: str, platform: str, kind: str, day: Column) -> None:
    """Appends to the landing folder as new immutable files, by platform, kind and day."""
    placed = df.withColumns({"platform": F.lit(platform), "kind": F.lit(kind), "dt": F.to_date(day)})
    keys = ["platform", "kind", "dt"]
    if fmt == "csv":
        flat_values(placed).write.mode("append").partitionBy(*keys).option("header", True).csv(path)
    elif fmt in ("json", "jsonl"):
        placed.write.mode("append").partitionBy(*keys).option("ignoreNullFields", False).json(path)
    elif fmt in ("parquet", "orc"):
        placed.write.mode("append").partitionBy(*keys).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in parts: the files, in the order of their names, make up the array; each line holds one record."""
    rows = staged(df.select(F.monotonically_increasing_id().alias("at"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("x")), "records")
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    if first is None:
        df.sparkSession.range(1).select(F.lit("[]").alias("value")).write.text(path)
        return
    line = F.concat(F.when(F.col("at") == first, "[").otherwise(""), "x", F.when(F.col("at") == last, "]").otherwise(","))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "at").sortWithinPartitions("at").select(line.alias("value")).write.text(path)


def read_json_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of an array that ``export_json_array`` wrote, line by line."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\[|[,\]]$", "").alias("x")).where("x not in ('', '[')")
    return lines.select(F.from_json("x", schema).alias("r")).select("r.*")


def export_sheets(sheets: dict[str, DataFrame], path: str) -> list[str]:
    """One folder of CSV a sheet; empty sheets are left out. Returns the sheets written."""
    done = []
    for name, df in sheets.items():
        if not df.isEmpty():
            flat_values(df).write.option("header", True).csv(f"{path}/{name}")
            done.append(name)
    return done


_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def _workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """An XLSX file with inline strings."""
    out = io.BytesIO()
    names = list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_RELATIONS}"><sheets>' + "".join(f'<sheet name="{escape(n, _QUOTES)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            cell = lambda k, r, v: f'<c r="{_column(k)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", v))}</t></is></c>'
            rows = "".join(f'<row r="{r}">' + "".join(cell(k, r, v) for k, v in enumerate(row) if v) + "</row>" for r, row in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", _SHEET.format(rows))
    return out.getvalue()


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def export_workbooks(df: DataFrame, path: str, book: str, sheet: str, columns: list[str], order: str, most_rows: int = 1_000_000) -> None:
    """One XLSX workbook ``<book>.xlsx`` for each value of ``book``, one sheet for each value of ``sheet``, rows by ``order``; all values as text.

    A workbook is one file, so its rows are one group: ``book`` is chosen so that it stays small, and more than ``most_rows`` rows in one are an error.
    """
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner, recursive=True)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"a workbook has more than {most_rows} rows")
        pdf = pdf.sort_values("_order")
        sheets = {n: [columns, *[["" if v is None else str(v) for v in r] for r in part[columns].itertuples(index=False)]] for n, part in pdf.groupby("_sheet", sort=True)}
        where, at = fs.FileSystem.from_uri(f"{path}/{pdf['_book'].iloc[0]}.xlsx")
        with where.open_output_stream(at) as out:
            out.write(_workbook(sheets))
        return pd.DataFrame({"rows": [len(pdf)]})

    keyed = df.select(F.col(book).cast("string").alias("_book"), F.col(sheet).cast("string").alias("_sheet"), F.col(order).alias("_order"), *columns)
    keyed.groupBy("_book").applyInPandas(write, "rows bigint").agg(F.sum("rows")).collect()  # one number


def save(df: DataFrame, fmt: str, target: str, options: dict[str, str] | None = None) -> None:
    """Writes by the name of a store: files; ``db``, ``sqlite``, ``postgres`` and ``mysql`` by JDBC; or ``excel`` workbooks.

    With the option ``key`` (columns with commas between) a JDBC store is merged into, else appended to. Workbooks take the options ``book``, ``sheet`` and ``order``, which
    are columns.
    """
    options = dict(options or {})
    if fmt in ("csv", "json", "jsonl", "parquet", "orc"):
        df = flat_values(df) if fmt == "csv" else df
        df.write.mode("append").format("json" if fmt == "jsonl" else fmt).options(**options).save(target)
    elif fmt in ("db", "sqlite", "postgres", "mysql"):
        if key := options.pop("key", ""):
            upsert_table(df, options.pop("url"), target, key.split(","), properties=options)
        else:
            df.write.mode("append").format("jdbc").options(dbtable=target, **options).save()
    elif fmt == "excel":
        book, sheet, order = (options[k] for k in ("book", "sheet", "order"))
        export_workbooks(df, target, book, sheet, [c for c in df.columns if c not in (book, sheet)], order)
    elif fmt == "mongodb":
        raise ValueError(f"{fmt} needs a connector that is not on the class path")
    else:
        raise ValueError(f"unknown store {fmt}")


def find(df: DataFrame, equal: dict[str, object], limit: int = 0) -> DataFrame:
    """Rows whose columns equal the given values; limit 0 means all."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    return df.limit(limit) if limit else df
