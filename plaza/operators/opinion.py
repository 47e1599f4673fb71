"""Scoped reads, label aggregates, trends and inflections over comments and their analyses.

``comments`` and ``analyses`` are DataFrames; an analysis is one labelling of a comment, and the latest one counts. Scope filters are
applied to comments before the latest analyses are ranked, so that they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.functions import scalar as S
from plaza.functions.digest import set_digest
from plaza.functions.segment import Dictionary, segmented
from plaza.sources.paths import staged

_CJK = "㐀-䶿一-鿿"
DIMENSIONS = ("sentiment", "emotion", "stance", "risk_level")


def in_scope(df: DataFrame, platform: str | None = None, run_id: str | None = None, content_id: object = None) -> DataFrame:
    """Rows of a platform, run and content, each if given."""
    for column, value in (("platform", platform), ("run_id", run_id), ("content_id", content_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def between(df: DataFrame, start: str | None, end: str | None, column: str = "published_at") -> DataFrame:
    """Rows in the half-open time range; a reversed range is an error."""
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast(df.schema[column].dataType))
    return df


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0, most: int = 1000) -> DataFrame:
    """One page of a total order."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def contents_page(contents: DataFrame, **paging: int) -> DataFrame:
    return page(contents, [F.col("published_at").desc_nulls_last(), F.col("content_id")], **paging)


def comments_page(comments: DataFrame, content_id: object = None, parent: object = None, depth: int | None = None, **paging: int) -> DataFrame:
    if depth is not None and depth < 0:
        raise ValueError("depth must be at least 0")
    comments = in_scope(comments, content_id=content_id)
    if parent is not None:
        comments = comments.where(F.col("parent_comment_id") == parent)
    if depth is not None:
        comments = comments.where(F.col("depth") == depth)
    return page(comments, [F.col("published_at").asc_nulls_last(), F.col("comment_id")], **paging)


def authors_page(authors: DataFrame, **paging: int) -> DataFrame:
    return page(authors, [F.col("nickname").asc_nulls_last(), F.col("author_id")], **paging)


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` for ``ids`` (position, id), each once, with the first position they were asked for."""
    first = ids.groupBy("id").agg(F.min("position").alias("position"))
    return df.join(first, df[key] == first["id"]).drop("id")


def latest(analyses: DataFrame, comments: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The newest analysis of each comment (created_at, then id), for comments in ``comments`` if given."""
    if comments is not None:
        analyses = analyses.join(comments.select("comment_id").distinct(), "comment_id", "left_semi")
    if columns is not None:
        analyses = analyses.select("comment_id", "created_at", "id", *[c for c in columns if c not in ("comment_id", "created_at", "id")])
    newest = Window.partitionBy("comment_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return analyses.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def first_cached(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The oldest row of each key (created_at, then id)."""
    oldest = Window.partitionBy(*key).orderBy("created_at", "id")
    return rows.withColumn("_rank", F.row_number().over(oldest)).where("_rank = 1").drop("_rank")


def comment_statistics(comments: DataFrame) -> DataFrame:
    return comments.agg(
        F.count("*").alias("comments"), F.count_if(F.col("depth") == 0).alias("roots"), F.count_if(F.col("depth") > 0).alias("replies"),
        F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at"),
    )


def run_statistics(comments: DataFrame, contents: DataFrame) -> DataFrame:
    """Per run: comments, roots, replies, contents and distinct authors of either."""
    c = comments.groupBy("run_id").agg(F.count("*").alias("comments"), F.count_if(F.col("depth") == 0).alias("roots"), F.count_if(F.col("depth") > 0).alias("replies"))
    t = contents.groupBy("run_id").agg(F.count("*").alias("contents"))
    people = comments.select("run_id", "author_id").union(contents.select("run_id", "author_id")).distinct()
    a = people.groupBy("run_id").agg(F.count("author_id").alias("authors"))
    return c.join(t, "run_id", "full").join(a, "run_id", "full").na.fill(0)


def coverage(comments: DataFrame, analyses: DataFrame) -> DataFrame:
    """Comments, and those with an analysis."""
    known = analyses.select("comment_id").distinct().withColumn("_known", F.lit(1))
    return comments.join(known, "comment_id", "left").agg(F.count("*").alias("total"), F.count("_known").alias("analyzed"))


def distribution(newest: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """(dimension, value, count, percentage of analysed comments), in one pass over the labels."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions]))
    counted = newest.select(pairs.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("dimension"))
    return counted.withColumn("percentage", F.round(100 * F.col("count") / total, 2))


def score_statistics(newest: DataFrame) -> DataFrame:
    return newest.agg(F.min("sentiment_score").alias("min_score"), F.max("sentiment_score").alias("max_score"), F.round(F.avg("sentiment_score"), 4).alias("mean_score"))


def frequency(newest: DataFrame, column: str, top_k: int = 20) -> DataFrame:
    """The most frequent values of an array column; values of white space do not count, others count untrimmed, and repeats all count."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    values = newest.select(F.explode(column).alias("value")).where(F.trim("value") != "")
    return values.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(top_k)


def topic_breakdown(newest: DataFrame, dimension: str, top_k: int = 10) -> DataFrame:
    """Counts of the most frequent topics by the values of another label; only empty topics are left out."""
    pairs = newest.select(F.explode("topics").alias("topic"), F.col(dimension).alias("value")).where("topic <> ''")
    counted = pairs.groupBy("topic", "value").agg(F.count("*").alias("count"))
    top = counted.groupBy("topic").agg(F.sum("count").alias("all")).orderBy(F.desc("all"), "topic").limit(top_k)
    return counted.join(top.select("topic"), "topic")


def volume_by_date(comments: DataFrame) -> DataFrame:
    return comments.where("published_at is not null").groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("comments"))


def trend(comments: DataFrame, analyses: DataFrame, bucket: str = "day") -> DataFrame:
    """Counts per hour or day of all comments with a time, with the labels of their latest analyses; quiet buckets have no row."""
    if bucket not in ("hour", "day"):
        raise ValueError("bucket must be hour or day")
    timed = comments.where("published_at is not null").select("comment_id", "published_at")
    newest = latest(analyses, timed, ["sentiment", "risk_level", "sentiment_score"]).drop("created_at", "id").withColumn("_known", F.lit(1))
    both = timed.join(newest, "comment_id", "left").groupBy(F.date_trunc(bucket, "published_at").alias("bucket_start"))
    named = lambda column, value: F.count_if(F.col(column) == value)
    return both.agg(
        F.count("*").alias("total_comments"), F.count("_known").alias("analyzed_comments"),
        named("sentiment", "positive").alias("positive_count"), named("sentiment", "neutral").alias("neutral_count"), named("sentiment", "negative").alias("negative_count"),
        named("risk_level", "low").alias("low_risk_count"), named("risk_level", "medium").alias("medium_risk_count"), named("risk_level", "high").alias("high_risk_count"),
        F.round(F.avg("sentiment_score"), 4).alias("mean_sentiment_score"),
    )


def trend_measures(buckets: DataFrame) -> DataFrame:
    """Adds coverage, ratios and the risk score to trend buckets."""
    n = F.col("analyzed_comments")
    ratio = lambda c: F.when(n > 0, F.round(F.col(c) / n, 4)).otherwise(0.0)
    return (
        buckets.withColumn("coverage", F.round(n / F.col("total_comments"), 4))
        .withColumn("negative_ratio", ratio("negative_count"))
        .withColumn("high_risk_ratio", ratio("high_risk_count"))
        .withColumn("risk_score", S.risk_score(F.col("negative_count"), F.col("medium_risk_count"), F.col("high_risk_count"), n))
    )


def trend_summary(points: DataFrame) -> DataFrame:
    """One row: totals, overall score, coverage, data quality and the peak (of equal peaks the later)."""
    n, total = F.col("analyzed_comments"), F.col("total_comments")
    one = points.agg(
        F.coalesce(F.sum("total_comments"), F.lit(0)).alias("total_comments"), F.coalesce(F.sum("analyzed_comments"), F.lit(0)).alias("analyzed_comments"),
        F.sum("negative_count").alias("negative"), F.sum("medium_risk_count").alias("medium"), F.sum("high_risk_count").alias("high"),
        F.max(F.struct("risk_score", "bucket_start")).alias("peak"),
    )
    share = F.when(total > 0, n / total).otherwise(0.0)
    quality = F.when(total == 0, "no_data").when(n == 0, "no_analyses").when(share < 0.8, "partial").otherwise("sufficient")
    return one.select(
        total, n, F.round(share, 4).alias("analysis_coverage"), quality.alias("data_quality"),
        S.risk_score(F.col("negative"), F.col("medium"), F.col("high"), n).alias("overall_risk_score"), F.when(n > 0, F.col("peak.bucket_start")).alias("peak_risk_at"),
    )


def inflections(points: DataFrame, bucket: str = "day", least: int = 10, most: int | None = 20) -> DataFrame:
    """Buckets that differ from the one right before: risk spikes, recoveries and volume surges; the strongest ``most`` of them, or all.

    Fixed values: a score change of 15 counts and of 30 is high; a volume change of 50 % counts, and 100 % weighs as much as 20 points.

    Buckets are one row for each hour or day, so the one ordered window over them is small.
    """
    order = Window.orderBy("bucket_start")
    gap = {"hour": 3600, "day": 86400}[bucket] * 1.5
    base = points.agg(F.greatest(F.median("total_comments"), F.lit(1.0)).alias("base"))
    before = lambda c: F.lag(c).over(order)
    x = points.join(F.broadcast(base)).select(
        "bucket_start", "total_comments", "base",
        (F.col("bucket_start").cast("timestamp").cast("double") - before("bucket_start").cast("timestamp").cast("double")).alias("gap"),
        before("total_comments").alias("was"), F.round(F.col("risk_score") - before("risk_score"), 2).alias("score_delta"),
    )
    total = F.col("total_comments")
    x = x.where((F.col("gap") <= gap) & (total >= least))
    x = x.withColumn("volume_change_ratio", F.round((total - F.col("was")) / F.greatest(F.col("was"), F.lit(1)), 4))
    surge = (total >= F.greatest(F.lit(float(least)), 3 * F.col("base"))) & (total - F.col("was") >= F.greatest(F.lit(5.0), 2 * F.col("base"))) & (F.col("volume_change_ratio") >= 0.5)
    x = x.withColumn("kind", F.when(F.col("score_delta") >= 15, "risk_spike").when(F.col("score_delta") <= -15, "recovery").when(surge, "volume_surge")).where("kind is not null")
    size = F.when(F.col("kind") == "volume_surge", F.col("volume_change_ratio") * 20).otherwise(F.abs("score_delta"))
    x = x.withColumn("severity", F.when(size >= 30, "high").when(size >= 15, "medium").otherwise("low"))
    strength = F.greatest(F.abs("score_delta"), F.abs("volume_change_ratio") * 20)
    ranked = x.orderBy(strength.desc(), "bucket_start").limit(most) if most is not None else x
    return ranked.select("bucket_start", "kind", "severity", "score_delta", "volume_change_ratio").orderBy("bucket_start")


def opinion_summary(comments: DataFrame, analyses: DataFrame, top_k: int = 10) -> DataFrame:
    """All sections of a public-opinion summary as long rows (section, key, subkey, n, percentage)."""
    newest = staged(latest(analyses, comments), "newest")
    row = lambda df, section, key, sub, n, pct: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), sub.cast("string").alias("subkey"), n.cast("double").alias("n"), pct.cast("double").alias("percentage"))  # noqa: E731, E501
    none = F.lit(None)
    cover = coverage(comments, analyses)
    status = F.when(F.col("analyzed") == 0, "no_analyses").when(F.col("analyzed") < F.col("total"), "partial").otherwise("complete")
    parts = [
        row(cover, "coverage", status, none, F.col("analyzed"), F.round(100 * F.col("analyzed") / F.col("total"), 2)),
        row(score_statistics(newest), "score", F.lit("mean"), none, F.col("mean_score"), none),
        row(newest.agg(F.count_if(F.col("risk_level") == "high").alias("n")), "high_risk", F.lit("high"), none, F.col("n"), none),
        row(distribution(newest), "distribution", F.col("dimension"), F.col("value"), F.col("count"), F.col("percentage")),
        row(volume_by_date(comments), "volume", F.col("day"), none, F.col("comments"), none),
    ]
    parts += [row(frequency(newest, c, top_k), c, F.col("value"), none, F.col("count"), none) for c in ("topics", "keywords", "risk_reasons")]
    parts += [row(topic_breakdown(newest, d, top_k), f"topic_{d}", F.col("topic"), F.col("value"), F.col("count"), none) for d in ("sentiment", "risk_level")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def high_risk(comments: DataFrame, analyses: DataFrame, limit: int = 20) -> DataFrame:
    """The most liked comments whose latest analysis says high risk."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    risky = latest(analyses, comments, ["risk_level"]).where("risk_level = 'high'").select("comment_id")
    order = [F.col("like_count").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("comment_id")]
    return comments.join(risky, "comment_id").orderBy(*order).limit(limit)


def capped(df: DataFrame, key: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each key, in order: the per-content or per-keyword-and-day collection limits."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def keep_first_text(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each text key."""
    return capped(df.withColumn("_text", key), ["_text"], order, 1).drop("_text")


def min_max_within(df: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """log(1 + x) scaled to 0..1 within each group; 0 where a group has no spread."""
    x = F.log1p(F.greatest(F.coalesce(column, F.lit(0)), F.lit(0)))
    ends = df.groupBy(F.col(group).alias("_group")).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))  # a row for each group
    low, high = F.col("_low"), F.col("_high")
    joined = df.join(ends, F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.when(high > low, (x - low) / (high - low)).otherwise(0.0)).drop("_group", "_low", "_high")


def existing(comments: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments whose content exists on their platform, and the others."""
    known = contents.select("platform", "content_id").distinct()
    return comments.join(known, ["platform", "content_id"], "left_semi"), comments.join(known, ["platform", "content_id"], "left_anti")


def word_frequency(texts: Column, df: DataFrame, stop_words: Sequence[str] = (), top_k: int = 20, custom: Sequence[str] = (), dictionary: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """The most frequent words: Latin words, words of CJK runs, and custom words.

    With a ``dictionary`` of (word, weight) CJK runs are cut along the best path through their word graph, and custom words enter the dictionary; without
    one, runs give their pairs of neighbouring characters, and custom words are taken out first, so each occurrence counts once. A custom word that is
    not all CJK is always taken out first.
    """
    low = F.lower(F.coalesce(texts, F.lit("")))
    custom = sorted({w.lower() for w in custom if w.strip()}, key=lambda w: (-len(w), w))
    graphed = [w for w in custom if dictionary is not None and re.fullmatch(f"[{_CJK}]+", w)]
    taken = [w for w in custom if w not in graphed]
    named = "|".join(rf"\Q{w}\E" for w in taken)  # of words that begin alike the longest
    own = F.regexp_extract_all(low, F.lit(f"({named})")) if taken else F.array().cast("array<string>")
    rest = F.regexp_replace(low, named, " ") if taken else low
    latin = F.regexp_extract_all(rest, F.lit(rf"(?U)([\p{{L}}&&[^{_CJK}]]+)"))
    runs = F.regexp_extract_all(rest, F.lit(f"([{_CJK}]+)"))
    # Texts without CJK characters, most of all, are cut in one pass.
    plain = F.array_remove(F.split(rest, r"(?U)\P{L}+"), "")
    if dictionary is not None:
        found = F.when(rest.rlike(f"[{_CJK}]"), latin).otherwise(plain)
        cut = segmented(df.select(F.explode(runs).alias("run"), F.lit(1).cast("long").alias("n")), Dictionary(dictionary, graphed)).withColumnRenamed("n", "count")
    else:
        pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
        found, cut = F.when(rest.rlike(f"[{_CJK}]"), F.concat(latin, pairs)).otherwise(plain), None
    counts = df.select(F.explode(F.concat(found, own)).alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    if cut is not None:
        counts = counts.unionByName(cut).groupBy("word").agg(F.sum("count").alias("count"))
    return (counts.where(~F.col("word").isin(*stop_words)) if stop_words else counts).orderBy(F.desc("count"), "word").limit(top_k)


def tree_hash(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, hash): one hash of all (key, value) of each group, whatever their order; keys are of any type."""
    return set_digest(rows, [group], F.concat_ws(":", F.col(key).cast("string"), F.coalesce(value, F.lit("")))).select(group, "hash")
