"""Token ids as Parquet list columns: range-partitioned files, delta encoding, bounded row groups and pages.

Documents are range-partitioned by doc_id and sorted, so the files hold the ids of ascending doc_ids. The ids are one list column;
Parquet's version 2 writer encodes it as deltas in binary packing (or by dictionary, if asked), row groups and pages
are bounded, and the writer stores page indexes, so a reader that needs few documents or only the metadata columns
(doc_id, part, at, n_tokens) reads those pages alone. ``part`` is the file's range and ``at`` the ids before a document
in that range; the ids before a range are a running sum over one row for each range.

Texts are encoded with a public tokenizer whose pre-tokens never cross white space, so each distinct run between spaces,
tabs and line ends is encoded once and its ids are reused by all tasks of a worker process. That equals encoding the whole text (tests check it).

Cases: a null or empty text has only the end id; rows that repeat a doc_id stand together, in the order of their texts; a
null doc_id comes first; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from plaza.llm.shared import shared_dir, slices

_FILE = "doc_id bigint, part int, at bigint, n_tokens int, ids array<int>"
_HOLDER = "plaza_encoders_of_process"
_RUNS = re.compile(r"[^ \t\r\n]+")
_SYMBOLS = re.compile(r"[^\w\s]+")
#: Latin-1 bytes as p (full stop or comma), s (other symbols), white space, or w.
_KINDS = bytes(ord("p" if chr(b) in ".," else " " if chr(b).isspace() else "w" if chr(b).isalnum() else "s") for b in range(256))


class Encoder:
    """Ids of whole texts as little-endian bytes, with the ids of runs kept between texts.

    What the tokenizer's normaliser and pre-tokenizer would do to Latin-1 texts is done ahead for the whole text: lower case, and a space at
    the edges of runs of symbols, where the pre-tokenizer cuts (but not in texts with apostrophes, which it may join to letters). So equal words are equal runs. A run of letters is given
    straight to the tokenizer's model; all other runs, and all other texts, pass through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the byte-level alphabet: other bytes follow from U+0100 on
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(0x100 + k) for k, b in enumerate(hidden)}

    @classmethod
    def of_process(cls, path: str) -> Encoder:
        """One for all tasks of a worker process. Functions travel by value, so a module of its own keeps it."""
        kept = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER))
        if path not in vars(kept):
            setattr(kept, path, cls(path))
        return getattr(kept, path)

    def _of_run(self, run: str) -> bytes:
        if run.isalpha() and run.islower():
            if run.isascii():
                return array("i", [t.id for t in self.tokenizer.model.tokenize(run)]).tobytes()
            if max(run) < "\u0100":
                letters = run.encode().decode("latin-1").translate(self.alphabet)
                return array("i", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<i4").tobytes()

    def _runs(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, but not to the tokenizer
            return _RUNS.findall(text)
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            return text.split()
        if "<|" in text:  # special tokens are matched as they are written
            return text.split()
        text = text.lower()
        if any(x in kinds for x in (b"ws", b"sw", b"ps", b"sp", b"pp")):
            if "'" not in text and "_" not in text:
                text = _SYMBOLS.sub(r" \g<0> ", text)
        else:
            text = text.replace(",", " ,").replace(".", " .")
        return text.split()

    def __call__(self, texts: list[str | None], end: int) -> list[bytes]:
        known, stop, out = self.known, array("i", [end]).tobytes(), []
        for text in texts:
            runs = self._runs(text or "")
            ids = list(map(known.get, runs))
            if None in ids:
                i = -1
                for _ in range(ids.count(None)):
                    i = ids.index(None, i + 1)
                    got = known.get(runs[i])
                    if got is None:
                        got = self._of_run(runs[i])
                        if len(known) < self.most:
                            known[runs[i]] = got
                    ids[i] = got
            ids.append(stop)
            out.append(b"".join(ids))
        return out


def _encode(path: str, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = Encoder.of_process(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                some = b.slice(lo, 200)
                ids = encoder(some.column(1).to_pylist(), end)
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), pa.array(n.astype(np.int32)), lists], names=["doc_id", "part", "at", "n_tokens", "ids"])
                at += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, encoding: str = "delta", row_group_bytes: int = 16 << 20, page_rows: int = 1000) -> None:
    """Writes ``docs`` (doc_id, text) to token files at ``path``. ``encoding`` is ``delta`` or ``dictionary``."""
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text")
    ordered = ordered.repartitionByRange(slices(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    coded = ordered.mapInArrow(_encode(tokenizer or public_tokenizers.path("word_bpe_49k.json"), end), _FILE)
    options = {
        "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": "zstd",
    }
    coded.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of token files; columns that a query leaves out are not read."""
    files = spark.read.schema(_FILE).parquet(path)
    parts = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))  # one row for each range
    return files.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, offsets = b.column(3).values.to_numpy().astype("<u4"), b.column(3).offsets.to_numpy()
        crc = [zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(_checksum, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(docs: DataFrame, name: str = "tokens") -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads their digest back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return checksums(read_tokens(spark, path))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_token_files": op10_token_files}
