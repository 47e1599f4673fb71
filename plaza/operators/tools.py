"""The eight read tools that an assistant may call. Each works within the scope that it was given, whatever a request names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.operators import opinion as O
from plaza.operators import semantic as M

SCOPE = ("platform", "run_id", "content_id")


def agreed(scope: Mapping[str, object], request: Mapping[str, object]) -> dict[str, object]:
    """The scope, if the request names no other value for a part of it; the request may leave parts out."""
    for k, v in request.items():
        if k not in SCOPE or (v is not None and v != scope.get(k)):
            raise ValueError(f"the request leaves its scope: {k}")
    return {k: scope[k] for k in SCOPE if scope.get(k) is not None}


def content_info(contents: DataFrame, scope: Mapping[str, object], payload: tuple[str, ...] = ("payload", "raw")) -> DataFrame:
    """The contents in scope without their payload."""
    return O.in_scope(contents, **scope).drop(*payload)


def some_comments(comments: DataFrame, scope: Mapping[str, object], limit: int = 50) -> DataFrame:
    """At most 50 comments in scope, oldest first."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    return O.page(O.in_scope(comments, **scope), [F.col("published_at").asc_nulls_last(), F.col("comment_id")], limit=limit)


def statistics(comments: DataFrame, analyses: DataFrame, scope: Mapping[str, object]) -> DataFrame:
    """(content_id, comments, analyzed, high_risk) in scope."""
    mine = O.in_scope(comments, **scope).select("comment_id", "content_id")
    both = mine.join(O.latest(analyses, mine, ["risk_level"]).select("comment_id", "id", "risk_level"), "comment_id", "left")
    return both.groupBy("content_id").agg(F.count("*").alias("comments"), F.count("id").alias("analyzed"), F.count_if(F.col("risk_level") == "high").alias("high_risk"))


def label_distribution(comments: DataFrame, analyses: DataFrame, scope: Mapping[str, object]) -> DataFrame:
    return O.distribution(O.latest(analyses, O.in_scope(comments, **scope)))


def topics(members: DataFrame, most: int = 20, representatives: int = 3) -> DataFrame:
    """(cluster, size, id, rank) of the largest topics with their first representatives; ``members`` has cluster, id, rank."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("_first")).orderBy(F.desc("size"), "_first").limit(most)
    return members.where(F.col("rank") <= representatives).join(size.drop("_first"), "cluster").select("cluster", "size", "id", "rank")


def trend_tail(comments: DataFrame, analyses: DataFrame, scope: Mapping[str, object], bucket: str = "hour", points: int = 48) -> DataFrame:
    """The last points of the trend in scope."""
    return O.trend(O.in_scope(comments, **scope), analyses, bucket).orderBy(F.desc("bucket_start")).limit(points)


def similar_comments(vectors: DataFrame, queries: DataFrame, comments: DataFrame, scope: Mapping[str, object], top_k: int = 10) -> DataFrame:
    """The comments in scope that are most similar to each query, itself left out."""
    mine = vectors.join(O.in_scope(comments, **scope).select("comment_id"), "comment_id", "left_semi").withColumnRenamed("comment_id", "item_id")
    found = M.search(mine, queries, min(50, top_k + 1)).where("query_id <> item_id")
    best = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def high_risk_comments(comments: DataFrame, analyses: DataFrame, scope: Mapping[str, object], limit: int = 20) -> DataFrame:
    """At most 20 comments in scope whose latest analysis says high risk."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be 1 to 20")
    return O.high_risk(O.in_scope(comments, **scope), analyses, limit)
