"""Mixing sources to target weights, in DataFrame operations only.

Weights are tempered shares: ``w_s ~ share_s ** t`` with one exponent t in [0, 1] for all sources (1: the natural
shares, 0: equal weights). The exponent is bisected to the smallest change that meets the goals: it is the largest t whose
normalised entropy reaches ``min_entropy``, but not below the smallest t at which no source has to be repeated more than
``max_repeats`` times. Both are monotone in t, so each round of the search evaluates a ladder of exponents in one grouped
job and keeps one rung.

The weights are then realised under a token budget. The default budget is the smallest in which every source is used in
full at least once. A source whose part of the budget is e epochs is taken whole floor(e) times, and for the rest its
documents are hashed into blocks, the blocks are put in a seeded random order, and whole blocks are taken while they
fit; only the block at the edge is cut, between documents, in a seeded order. So the running sums that decide are over
block totals, and over the documents of single blocks, never over all the documents of a source.

Cases: tokens are words, that is runs of non-white-space, and a null text has none; a source without tokens gets weight
0 and its documents are taken once; a null source is a source of its own; ties in the order are broken by doc_id; repeated
rows of one document fall into one block and are taken alike; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.llm.shared import staged

_RUNGS = 16


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, docs, tokens) of ``docs`` (source, n_tokens)."""
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def _ladder(totals: DataFrame, lo: float, hi: float) -> list[tuple[float, float, float]]:
    """(t, normalised entropy, repeats of the most repeated source if the least repeated is used once), for rungs from lo to hi."""
    steps = [lo + (hi - lo) * i / _RUNGS for i in range(_RUNGS + 1)]
    at = totals.where("tokens > 0").select("tokens", F.explode(F.array(*[F.lit(t) for t in steps])).alias("t"))
    x = F.pow(F.col("tokens").cast("double"), F.col("t"))
    got = at.groupBy("t").agg(
        F.sum(x).alias("z"), F.sum(x * F.log(x)).alias("zl"), F.count("*").alias("n"), F.max(x / F.col("tokens")).alias("most"), F.min(x / F.col("tokens")).alias("least")
    )
    entropy = F.when(F.col("n") > 1, (F.log("z") - F.col("zl") / F.col("z")) / F.log("n")).otherwise(1.0)
    return sorted(tuple(r) for r in got.select("t", entropy, F.col("most") / F.col("least")).collect())


def exponent(totals: DataFrame, min_entropy: float = 0.95, max_repeats: float = 2.0, rounds: int = 4) -> float:
    """The exponent that meets the goals; repeats outrank entropy."""
    lo_e, hi_e, lo_r, hi_r = 0.0, 1.0, 0.0, 1.0
    for _ in range(rounds):
        if rungs := _ladder(totals, lo_e, hi_e):
            good = [t for t, e, _ in rungs if e >= min_entropy]
            lo_e = max(good, default=rungs[0][0])
            hi_e = min((t for t, _, _ in rungs if t > lo_e), default=lo_e)
        if rungs := _ladder(totals, lo_r, hi_r):
            good = [t for t, _, r in rungs if r <= max_repeats * (1 + 1e-12)]
            hi_r = min(good, default=rungs[-1][0])
            lo_r = max((t for t, _, _ in rungs if t < hi_r), default=hi_r)
    return max(lo_e, hi_r)


def weights(totals: DataFrame, t: float, budget: int | None = None) -> DataFrame:
    """(source, docs, tokens, weight, epochs) at exponent ``t``; without a budget every source has at least one epoch."""
    x = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(t))).otherwise(0.0)
    z, need = totals.agg(F.sum(x), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / x))).first()
    total = float(budget) if budget is not None else (need or 0.0) * (z or 0.0)
    out = totals.withColumn("weight", x / F.lit(z) if z else F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(total) / F.col("tokens"), 9)).otherwise(1.0)
    return out.withColumn("epochs", epochs)


def realise(docs: DataFrame, weighted: DataFrame, seed: int = 11, block_docs: int = 2000) -> DataFrame:
    """``docs`` (doc_id, source, n_tokens, ...) with weight, block and copies (how often the document is in the mix) added."""
    plan = weighted.select(
        F.col("source").alias("_source"), "weight", F.floor("epochs").alias("whole"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"),
        F.ceil(F.col("docs") / block_docs).cast("int").alias("blocks"),
    )
    placed = docs.join(plan, docs["source"].eqNullSafe(plan["_source"])).drop("_source")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    totals = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed + 1)), "block")
    before = F.sum("block_tokens").over(order) - F.col("block_tokens")
    taken = totals.withColumn("room", F.col("rest") - before).select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "room", F.when(F.col("room") >= F.col("block_tokens"), "all").when(F.col("room") > 0, "part").otherwise("none").alias("take")
    )
    both = placed.drop("rest").join(taken, placed["source"].eqNullSafe(taken["_source"]) & (placed["block"] == taken["_block"])).drop("_source", "_block")
    # Only blocks at the edge, one for each source, are ordered by document.
    edge = both.where("take = 'part'")
    inner = Window.partitionBy("source", "block").orderBy(F.struct(F.xxhash64("doc_id", F.lit(seed + 2)), F.col("doc_id"))).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("extra", (F.sum("n_tokens").over(inner) <= F.col("room")).cast("long"))
    out = both.where("take <> 'part'").withColumn("extra", (F.col("take") == "all").cast("long")).unionByName(edge)
    return out.withColumn("copies", F.col("whole") + F.col("extra")).drop("whole", "blocks", "room", "take", "extra")


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_tokens", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("long"))


def mix(docs: DataFrame, min_entropy: float = 0.95, max_repeats: float = 2.0, budget: int | None = None, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, source, n_tokens, ...) with weight, block and copies."""
    totals = staged(source_tokens(docs), "sources")
    return realise(docs, weights(totals, exponent(totals, min_entropy, max_repeats), budget), seed)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text")
    return mix(staged(docs, "counted")).select("doc_id", "source", "n_tokens", "weight", "block", "copies")


QUERIES = {"op8_mixing": op8_mixing}
