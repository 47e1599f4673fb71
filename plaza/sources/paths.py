"""The folder for files that jobs write and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors share; made only in local mode, where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one job writes to the shared folder and reads again, by name; those that no plan reads any more are dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def path(self, name: str) -> str:
        self.paths.setdefault(name, []).append(fresh(self.spark, name))
        return self.paths[name][-1]

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but: int = 0) -> None:
        """Deletes the tables of these names, but for the last few."""
        for name in names:
            paths = self.paths.pop(name, [])
            old = paths[: len(paths) - but]
            self.paths[name] = paths[len(old) :]
            for at in old:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as soon as it has run; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)
