"""Keyed merges of new rows into stored tables. Each returns the new state; ``replace_partitions`` makes it durable."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERWRITE, KEEP_IF_NULL, KEEP = "overwrite", "keep_if_null", "keep"


def last_wins(batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the ingest order (a grouped ``max_by``, combined before the shuffle)."""
    rest = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def upsert(stored: DataFrame, batch: DataFrame, key: Sequence[str], rules: Mapping[str, str] | None = None, default: str = OVERWRITE) -> DataFrame:
    """``stored`` with ``batch`` (one row a key) merged in, in one full outer join.

    A column of a stored row is overwritten, overwritten unless the new value is null, or kept, by its rule. Columns that
    ``batch`` lacks are kept, and null in new rows; so a batch with few columns is a partial document update.
    """
    rules = rules or {}
    marked = batch.withColumnsRenamed({c: f"_new_{c}" for c in batch.columns if c not in key}).withColumn("_in_batch", F.lit(True))
    both = stored.withColumn("_is_stored", F.lit(True)).join(marked, list(key), "full")

    def merged(c: str) -> Column:
        if c not in batch.columns:
            return F.col(c)
        rule, new = rules.get(c, default), F.col(f"_new_{c}")
        if rule not in (OVERWRITE, KEEP_IF_NULL, KEEP):
            raise ValueError(f"unknown rule {rule}")
        if rule == KEEP:
            return F.when(F.col("_is_stored"), F.col(c)).otherwise(new)
        if rule == KEEP_IF_NULL:
            return F.coalesce(new, F.col(c))
        return F.when(F.col("_in_batch"), new).otherwise(F.col(c))

    return both.select(*[F.col(c) if c in key else merged(c).alias(c) for c in stored.columns])


def upsert_counters(stored: DataFrame, batch: DataFrame, key: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """As ``upsert``, but only counters of stored rows change."""
    return upsert(stored, batch, key, {c: OVERWRITE for c in counters}, KEEP)


def landing_upsert(stored: DataFrame, batch: DataFrame, key: Sequence[str], now: int) -> DataFrame:
    """A landing table with a batch merged in: all columns given are overwritten; new rows get ``add_ts``, all touched rows ``last_modify_ts``."""
    stamped = batch.withColumns({"add_ts": F.lit(now), "last_modify_ts": F.lit(now)})
    return upsert(stored, stamped, key, {"add_ts": KEEP})


def upsert_counts(stored: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: items, inserted keys, and duplicates (items less inserted, so repeats within the batch count)."""
    new = batch.select(*key).distinct().join(stored.select(*key), list(key), "left_anti").agg(F.count("*").alias("inserted"))
    return batch.agg(F.count("*").alias("items")).crossJoin(F.broadcast(new)).withColumn("duplicates", F.col("items") - F.col("inserted"))  # one row each


def insert_if_absent(stored: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``stored`` with the first row of each new key appended."""
    rest = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")
    return stored.unionByName(first.join(stored.select(*key), list(key), "left_anti").select(*stored.columns))


def replace_group(stored: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """``stored`` with all rows of the groups in ``rows`` replaced by ``rows``."""
    return stored.join(rows.select(group).distinct(), group, "left_anti").unionByName(rows)


def fail_group(stored: DataFrame, group: str, value: object, state: Mapping[str, object]) -> DataFrame:
    """``stored`` with columns of one group set to a failed state."""
    mine = F.col(group) == value
    return stored.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)).cast(stored.schema[c].dataType) for c, v in state.items()})


def update_run(runs: DataFrame, run_id: object, changes: Mapping[str, object], allowed: Sequence[str]) -> DataFrame:
    """One run with known columns changed; an unknown column is an error."""
    if unknown := set(changes) - set(allowed):
        raise ValueError(f"columns that may not change: {sorted(unknown)}")
    return fail_group(runs, "id", run_id, changes)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes ``df`` over its partitions of the Parquet table at ``path``.

    The rows are first staged beside the table, so the table may be an input of ``df``, and then replace exactly the partitions they have.
    """
    stage = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    staged = df.sparkSession.read.schema(df.schema).parquet(stage)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
