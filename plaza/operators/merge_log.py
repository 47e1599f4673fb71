"""A table of keyed rows as a bucketed base and a log of batches: a batch writes its own rows only, and reading shuffles the log only.

The newest row of a key wins, by the order columns. The base holds all batches before a number and is bucketed and sorted by the key, so that it is joined to
the log without an exchange. Once the log has grown past a share of the base, ``compact`` writes the next base. A batch that is run again
overwrites its own folder, and ``read(before=k)`` gives the table as it was before batch ``k``, so a step that failed halfway is repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaza.operators.merge import last_wins


@dataclass(frozen=True)
class LogTable:
    """``name`` is for the catalog, ``path`` a shared folder; rows have ``schema``, with ``key`` and ``order`` columns in it."""

    spark: SparkSession
    name: str
    path: str
    schema: T.StructType
    key: Sequence[str]
    order: Sequence[str]
    buckets: int = 16

    def _folder(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of complete folders, ``base=`` or ``batch=``."""
        files, path = self._folder(f"{self.path}/{kind}")
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith(f"{kind}=") and files.exists(self._folder(f"{p}/_SUCCESS")[1]))

    def _base(self, before: int | None) -> int | None:
        return max((k for k in self._numbers("base") if before is None or k <= before), default=None)

    def _stored(self, upto: int) -> DataFrame:
        table = f"{self.name}_{upto}"
        if not self.spark.catalog.tableExists(table):  # of an earlier session
            columns, key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), ", ".join(self.key)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/base/base={upto}'")
        return self.spark.table(table)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds the newest row of each key of a batch."""
        last_wins(rows.select(*self.schema.names), self.key, self.order).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch/batch={batch}")

    def log(self, before: int | None = None) -> DataFrame:
        """The newest rows of the batches that no base holds yet."""
        upto = self._base(before)
        parts = [k for k in self._numbers("batch") if (upto is None or k >= upto) and (before is None or k < before)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch/batch={k}" for k in parts])
        return last_wins(rows, self.key, self.order).select(*self.schema.names)

    def read(self, before: int | None = None) -> DataFrame:
        """All keys with their newest rows, of all batches or of those before a number."""
        upto, log = self._base(before), self.log(before)
        if upto is None:
            return log
        rest = [c for c in self.schema.names if c not in self.key]
        stored = self._stored(upto).select(*self.key, F.struct(*rest).alias("_old"), F.struct(*self.order).alias("_was"))
        new = log.select(*self.key, F.struct(*rest).alias("_new"), F.struct(*self.order).alias("_is"))
        both = stored.join(new, list(self.key), "full")
        row = F.when(F.col("_was").isNull() | (F.col("_is") >= F.col("_was")), F.col("_new")).otherwise(F.col("_old"))
        return both.select(*self.key, row.alias("_row")).select(*[c if c in self.key else F.col(f"_row.{c}").alias(c) for c in self.schema.names])

    def compact(self, before: int, ratio: float = 0.5) -> bool:
        """Writes a base of all batches before a number, if their log has more than ``ratio`` of the old base's rows; older folders go."""
        upto, log = self._base(before), self.log(before).count()
        if not log or (upto is not None and log <= ratio * self._stored(upto).count()):
            return False
        table, place = f"{self.name}_{before}", f"{self.path}/base/base={before}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.read(before).write.mode("overwrite").bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", place).saveAsTable(table)
        for kind, gone in (("batch", [k for k in self._numbers("batch") if k < before]), ("base", [] if upto is None else [upto])):
            for k in gone:
                files, path = self._folder(f"{self.path}/{kind}/{kind}={k}")
                files.delete(path, True)
        return True
