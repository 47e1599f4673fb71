"""Deterministic samples: the same rows whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.functions import scalar as S
from plaza.sources.paths import staged


def hash_rank(seed: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def strata(comments: DataFrame, seed: str, rules: Sequence[str] = S.EXCLUSION_RULES) -> DataFrame:
    """Adds normalized text, eligibility by ``rules``, length bucket, stratum and sample rank to (comment_id, text, depth)."""
    x = comments.withColumn("normalized", S.normalize_text("text"))
    x = x.withColumn("exclusion_reason", S.exclusion_reason(F.col("normalized"), rules=rules)).withColumn("quality_eligible", F.col("exclusion_reason").isNull())
    x = x.withColumn("length_bucket", S.length_bucket(S.informative_count(F.coalesce("normalized", F.lit("")))))
    family = F.when(F.col("quality_eligible"), "eligible").otherwise(F.concat(F.lit("excluded:"), F.col("exclusion_reason")))
    x = x.withColumn("stratum", F.concat_ws("|", family, "length_bucket", F.when(F.col("depth") == 0, "root").otherwise("reply")))
    return x.withColumn("text_hash", F.sha2("normalized", 256)).withColumn("sample_rank", hash_rank(seed, F.col("comment_id")))


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row among those of its key, by ``order``; ties by equal order are broken at will.

    Rows are dealt by ranges of key and order, so a key with very many rows is spread over partitions. Rows are numbered within each, and the rows
    of the key in the partitions before are added.
    """
    names = [f"_o{i}" for i in range(len(order))]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(parts, key, *names)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    local = F.row_number().over(Window.partitionBy("_part", key).orderBy(*names))
    sizes = ranged.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", "_k", before.alias("_before"))
    placed = ranged.withColumn("_local", local).join(offsets, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return placed.withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop("_local", "_before", "_part", "_p", "_k", *names)


def round_robin(df: DataFrame, stratum: str, rank: Column, tie: str) -> DataFrame:
    """Adds ``turn`` and ``position``: one row of each stratum in turn, in the order of their ranks.

    The position follows from the sizes of the strata: the rows of all earlier turns, and the strata up to this one that have this turn.
    """
    turned = numbered(df, stratum, [rank, F.col(tie)], "turn")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    sizes = sizes.agg(F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("_sizes"))
    own = sizes.select(F.col("_sizes._n").alias("_all"), F.posexplode("_sizes").alias("_i", "_own")).select("_all", "_i", F.col("_own._s").alias("_s"))
    earlier = F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, n: a + F.least(n, F.col("turn") - 1))
    same = F.size(F.filter(F.slice("_all", F.lit(1), F.col("_i") + 1), lambda n: n >= F.col("turn")))
    placed = turned.join(F.broadcast(own), F.col(stratum).eqNullSafe(F.col("_s")))  # a row for each stratum
    return placed.withColumn("position", (earlier + same).cast("int")).drop("_all", "_i", "_s")


def stratified_sample(comments: DataFrame, limit: int, seed: str, rules: Sequence[str] = S.EXCLUSION_RULES) -> DataFrame:
    """At most ``limit`` (1 to 100) rows: pairs of equal texts, then eligible rows by turns of strata up to 80 %, then excluded, then the rest.

    Each stage keeps at most ``limit`` rows of a stratum before it orders them all, so only heads of groups reach one task.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    x = strata(comments, seed, rules)
    keep = ["comment_id", "quality_eligible", "stratum", "sample_rank", "text_hash"]
    x = x.select(*keep)
    budget = min(10, (limit // 10) * 2)
    group = Window.partitionBy("text_hash").orderBy("sample_rank", "comment_id")
    heads = x.withColumn("_n", F.row_number().over(group)).where("_n <= 2")
    both = heads.groupBy("text_hash").agg(F.count("*").alias("n"), F.min("sample_rank").alias("head")).where("n = 2").orderBy("head", "text_hash").limit(budget // 2)
    pairs = heads.join(F.broadcast(both.select("text_hash", "head")), "text_hash").select(*keep, F.lit(0).alias("stage"), F.concat("head", F.col("_n").cast("string")).alias("at"))
    rest = x.join(F.broadcast(pairs.select("comment_id")), "comment_id", "left_anti")

    def turns(rows: DataFrame, stage: int) -> DataFrame:
        turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy("sample_rank", "comment_id"))).where(F.col("turn") <= limit)
        return turned.select(*keep, F.lit(stage).alias("stage"), F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("|"), "stratum").alias("at"))

    taken = pairs.agg(F.count_if("quality_eligible").alias("done"))
    eligible = turns(rest.where("quality_eligible"), 1).crossJoin(F.broadcast(taken))  # one row
    eligible = eligible.withColumn("_at", F.row_number().over(Window.orderBy("at", "comment_id"))).where(F.col("_at") <= F.greatest(F.lit(0), F.lit(round(limit * 0.8)) - F.col("done"))).drop("_at", "done")
    excluded = turns(rest.where("not quality_eligible"), 2)
    leftover = rest.join(F.broadcast(eligible.select("comment_id")), "comment_id", "left_anti").where("quality_eligible")
    leftover = leftover.orderBy("sample_rank", "comment_id").limit(limit).select(*keep, F.lit(3).alias("stage"), F.col("sample_rank").alias("at"))
    every = pairs.unionByName(eligible).unionByName(excluded).unionByName(leftover)
    return every.withColumn("position", F.row_number().over(Window.orderBy("stage", "at", "comment_id"))).where(F.col("position") <= limit).drop("stage", "at")


def hash_sample(df: DataFrame, key: str, snapshot: str, n: int) -> DataFrame:
    """The first n rows by sha256(key:snapshot), then key."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{snapshot}")), 256), key).limit(n)
