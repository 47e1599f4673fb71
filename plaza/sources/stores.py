"""Relational stores by JDBC: scans in partitions with pushed filters, and upserts through a staging table."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def _quoted(name: str) -> str:
    if '"' in name:
        raise ValueError(f"not a name: {name}")
    return f'"{name}"'


def read_table(spark: SparkSession, url: str, table: str, column: str, rows_per_part: int = 500_000, properties: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of ``table``, in parts of about ``rows_per_part`` rows by ranges of the numeric or time column ``column``.

    The ends of the ranges are one row from the store. Filters and columns of what is read reach the store; rows whose ``column`` is null are in the first part.
    """
    properties = dict(properties or {})
    c = _quoted(column)
    ends = spark.read.jdbc(url, f"(SELECT MIN({c}) AS LOW, MAX({c}) AS HIGH, COUNT(*) AS N FROM {table}) ENDS", properties=properties).first()
    parts = max(1, -(-int(ends[2]) // rows_per_part))
    if ends[0] is None or parts == 1 or ends[0] == ends[1]:
        return spark.read.jdbc(url, table, properties=properties)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=parts, **properties)
    return reader.load()


def _execute(spark: SparkSession, url: str, statements: Sequence[str], properties: Mapping[str, str]) -> None:
    """Runs statements in one transaction."""
    held = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        held.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, held)
    try:
        connection.setAutoCommit(False)
        todo = connection.createStatement()
        try:
            for s in statements:
                todo.executeUpdate(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            todo.close()
    finally:
        connection.close()


def upsert_table(df: DataFrame, url: str, table: str, key: Sequence[str], parts: int = 8, keep_if_null: bool = False, properties: Mapping[str, str] | None = None) -> None:
    """Merges ``df`` (one row a key, none of which is null) into ``table``: executors fill a staging table, and the store merges it in one transaction.

    A job that is run again after a failure merges the same rows; a staging table that is left over has a name of its own. ``parts`` bounds the connections.
    """
    properties, spark = dict(properties or {}), df.sparkSession
    stage = f"STAGE_{uuid.uuid4().hex.upper()}"
    df.coalesce(parts).write.mode("overwrite").jdbc(url, stage, properties=properties)
    names, rest = [_quoted(c) for c in df.columns], [_quoted(c) for c in df.columns if c not in key]
    on = " AND ".join(f"t.{_quoted(k)} = s.{_quoted(k)}" for k in key)
    new = lambda c: f"COALESCE(s.{c}, t.{c})" if keep_if_null else f"s.{c}"
    update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = {new(c)}' for c in rest)} " if rest else ""
    merge = f"MERGE INTO {table} t USING {stage} s ON {on} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) VALUES ({', '.join(f's.{c}' for c in names)})"
    try:
        _execute(spark, url, [merge], properties)
    finally:
        _execute(spark, url, [f"DROP TABLE {stage}"], properties)
