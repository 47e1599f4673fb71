"""WARC records in ZIP archives: writing, and reading by range without extraction.

Writing. Pages with equal payloads are found by a grouped ``min`` over payload digests; the smallest page_id is the response
and the others revisit it. Each task packs its pages into ZIP archives of a bounded number of records in the shared folder;
an archive has two stored members, ``archive/data.warc.gz`` (each record is a gzip member of its own, as is usual for WARC) and ``indexes/index.cdxj``. File names are unique for each attempt, and
only archives named in the manifest, which is a table written by the successful attempts, are ever read.

Reading (``read_archives``). From the end of the file the end-of-directory record is found, and with its ZIP64 locator and record if
a field overflows; then the central directory is parsed (ZIP64 extra fields too), the stored members are located behind their
local headers, the index is read, and each record is read by its own range. Payload length and digest are recomputed from responses.

Cases: a null html is an empty payload; repeated rows of a page are alike (all of the smallest page_id are responses); a null page_id
comes before all others and refers_to it is null; a null url has no target field; a url that cannot stand in a header as it is is
stored percent-encoded, with a field that gives back the very text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.shared import shared_dir, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_MANIFEST = "path string, records bigint, bytes bigint"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_AS_GIVEN = "X-Target-As-Given"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _target(url: str | None) -> list[str]:
    if url is None:
        return []
    shown = quote(url, safe=";/?:@&=+$,#%[]!*()~'")
    return [f"WARC-Target-URI: {shown}", *([] if shown == url else [f"{_AS_GIVEN}: {quote(url, safe='')}"])]


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but the HTTP headers of the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *_target(url),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"] if payload is None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None]:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = lambda f: int(x) if (x := fields[f].removeprefix("<urn:page:").removesuffix(">")) else None
    url = unquote(fields[_AS_GIVEN]) if _AS_GIVEN in fields else fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "revisit":
        size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
        return named("WARC-Record-ID"), url, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", named("WARC-Refers-To")
    return named("WARC-Record-ID"), url, len(payload), payload_digest(payload), "response", None


def _writer(folder: str, most: int):
    def archive(rows: list[tuple]) -> tuple[str, int, int]:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        system, inner = fs.FileSystem.from_uri(path)
        index, at = [], 0
        with system.open_output_stream(inner) as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                    for page_id, url, html, size, digest, revisit, refers_to in rows:
                        raw = gzip.compress(warc_record(page_id, url, None if revisit else (html or "").encode(), size, digest, refers_to), 5, mtime=0)
                        member.write(raw)
                        index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(raw)}))
                        at += len(raw)
                z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        return path, len(rows), at

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            got = archive(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=["path", "records", "bytes"])

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                page_id, url, html, n, sha1, revisit, refers_to = row
                held.append((page_id, url, html, n, base64.b32encode(bytes.fromhex(sha1)).decode(), revisit, refers_to))
                size += n
                if len(held) >= most or size > 64 << 20:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, records: int = 20_000) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives below ``folder``; the manifest (path, records, bytes)."""
    fs_made = f"{folder}/archives"
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint"))
    rows = rows.withColumn("sha1", F.sha1(F.coalesce("html", F.lit(""))))
    last = -(1 << 63)  # a null page_id comes first
    first = rows.groupBy("sha1", "size").agg(F.min(F.coalesce("page_id", F.lit(last))).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = rows.join(first, ["sha1", "size"], "left")
    revisit = F.coalesce((F.col("size") >= min_bytes) & (F.col("first") != F.coalesce("page_id", F.lit(last))), F.lit(False))
    both = both.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit") & (F.col("first") != last), F.col("first")))
    both = both.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "size", "sha1", "revisit", "refers_to")
    _make(fs_made)
    return staged(both.mapInArrow(_writer(fs_made, records), _MANIFEST), "manifest")


def _make(folder: str) -> None:
    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)


class ZipDirectory:
    """The members of a ZIP file (also ZIP64), read from its central directory by ranges of a random-access file."""

    def __init__(self, file, size: int):
        self.file = file
        tail = min(size, 65_557)
        raw = self.read(size - tail, tail)
        at = raw.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end-of-directory record")
        count, length, offset = struct.unpack("<HII", raw[at + 10 : at + 20])
        if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
            locator = self.read(size - tail + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = self.read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end-of-directory record")
            count, length, offset = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, at = self.read(offset, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            stored, full, names, extras, comments = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            header = struct.unpack("<I", raw[at + 42 : at + 46])[0]
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    stored = wide.pop(0) if stored == 0xFFFFFFFF else stored
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            self.members[name] = (method, header, stored)
            at += 46 + names + extras + comments

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, header, stored = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; ranges of it cannot be read")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        names, extras = struct.unpack("<HH", local[26:30])
        return header + 30 + names + extras, stored


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for path in b.column(0).to_pylist():
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as file:
                zipped = ZipDirectory(file, file.size())
                data, _ = zipped.locate(DATA)
                index = zipped.read(*zipped.locate(INDEX)).decode().split("\n")
                for lo in range(0, len(index), 500):
                    entries = [json.loads(x) for x in index[lo : lo + 500] if x]
                    got = [parse_record(gzip.decompress(zipped.read(data + e["offset"], e["length"]))) for e in entries]
                    columns = list(zip(*got, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives that ``manifest`` names, one archive a task at a time."""
    spark = manifest.sparkSession
    return manifest.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(_reader, _RECORD)


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hexadecimal digits are twenty bits, which are four base32 letters.
_DIGIT = "(strpos('0123456789abcdef', substr(h, CAST(i // 4 * 5 + {k} AS INT), 1)) - 1)"
_TWENTY = " + ".join(f"{16 ** (5 - k)} * {_DIGIT.format(k=k)}" for k in range(1, 6))
OP7_SQL = f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(floor(v / pow(32, 3 - i % 4)) AS INT) % 32 + 1, 1), '' ORDER BY i) AS payload_digest
  FROM (SELECT h, i, {_TWENTY} AS v FROM (SELECT DISTINCT h FROM h) x, range(0, 32) r(i)) y GROUP BY h),
b AS (SELECT h.*, payload_digest, min(page_id) OVER (PARTITION BY h.h) AS first FROM h JOIN d ON d.h = h.h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""

QUERIES = {"op7_warc_zip": op7_warc_zip}
ORACLES = {"op7_warc_zip": OP7_SQL}
