"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.shared import staged


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """One row (node, component) for each node of ``edges``; the component is its smallest node.

    Each round only groups by node with ``min`` and joins the result back, so a hub is summed before it is shuffled and
    its join can be split. Rounds grow with the logarithm of the longest path. Edges with a null end and loops are left out.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    now, sign, rounds = staged(now, "edges"), None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # In small-star every edge points from the larger node to the smaller.
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        pairs = down.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), "edges")
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        rounds += 1
        if tuple(got) == sign:
            break
        sign = tuple(got)
    member = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = member.select(F.col("component").alias("node"), "component").distinct()
    return member.union(roots)
