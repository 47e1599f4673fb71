"""Queries over comments and analyses: scoped reads, aggregates, windows, joins and trends, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.functions import scalar as S
from plaza.functions.digest import digest_sql, set_digest
from plaza.operators import opinion as O
from plaza.plans.record_queries import URL_BYTES, UUID_SQL
from plaza.plans.registry import load, query
from plaza.plans.views import cte, view

CA = cte("comments", "analyses")
CAL = cte("comments", "analyses", "latest")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments, analyses = _two(spark, sf_dir)
    return O.latest(analyses, comments)


# G: filters, lookups, pages ----------------------------------------------------------------------------------------------------


@query("g1_scope_filter", cte("comments") + "SELECT comment_id, content_id, platform, run_id FROM comments WHERE platform = 'douyin' AND run_id = 'run-1' AND content_id = 4")
def g1(spark, sf_dir):
    return O.in_scope(view(spark, sf_dir, "comments"), "douyin", "run-1", 4).select("comment_id", "content_id", "platform", "run_id")


@query("g2_list_contents", cte("contents") + "SELECT content_id, title, published_at FROM contents WHERE platform = 'douyin' ORDER BY published_at DESC NULLS LAST, content_id LIMIT 50 OFFSET 10")
def g2(spark, sf_dir):
    return O.contents_page(O.in_scope(view(spark, sf_dir, "contents"), "douyin"), limit=50, offset=10).select("content_id", "title", "published_at")


@query("g3_list_comments", cte("comments") + "SELECT comment_id, parent_comment_id, published_at FROM comments WHERE content_id = 3 AND depth = 1 ORDER BY published_at ASC NULLS LAST, comment_id LIMIT 100 OFFSET 5")
def g3(spark, sf_dir):
    return O.comments_page(view(spark, sf_dir, "comments"), content_id=3, depth=1, limit=100, offset=5).select("comment_id", "parent_comment_id", "published_at")


@query("g4_list_authors", cte("authors") + "SELECT author_id, nickname FROM authors ORDER BY nickname ASC NULLS LAST, author_id LIMIT 40 OFFSET 20")
def g4(spark, sf_dir):
    return O.authors_page(view(spark, sf_dir, "authors"), limit=40, offset=20).select("author_id", "nickname")


@query("g5_get_many", cte("comments") + "SELECT p AS position, c.comment_id, c.like_count FROM (SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY l_partkey) i JOIN comments c ON c.comment_id = i.id")
def g5(spark, sf_dir):
    asked = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return O.by_ids(view(spark, sf_dir, "comments"), "comment_id", asked).select("position", "comment_id", "like_count")


@query("g10_time_range", cte("comments") + "SELECT comment_id, published_at FROM comments WHERE published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at < TIMESTAMP '2024-01-08 12:00:00'")
def g10(spark, sf_dir):
    return O.between(view(spark, sf_dir, "comments"), "2024-01-05 00:00:00", "2024-01-08 12:00:00").select("comment_id", "published_at")


@query("g12_newest_artifact", "SELECT source AS kind, max(doc_id) AS generated_at, arg_max(n_chars, doc_id) AS report FROM documents GROUP BY source")
def g12(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("kind")).agg(F.max("doc_id").alias("generated_at"), F.max_by("n_chars", "doc_id").alias("report"))


_KEY = ["comment_id", "input_hash", "model"]


@query("g13_exact_cache_lookup", cte("comments", "analyses") + "SELECT c.comment_id, min(a.id) AS id FROM comments c JOIN analyses a ON a.comment_id = c.comment_id AND a.input_hash = concat('hash-', c.comment_id % 500) AND a.model = 'model-a' GROUP BY c.comment_id")
def g13(spark, sf_dir):
    comments, analyses = _two(spark, sf_dir)
    asked = comments.select("comment_id", F.concat(F.lit("hash-"), F.col("comment_id") % 500).alias("input_hash"), F.lit("model-a").alias("model"))
    return asked.join(analyses, _KEY).groupBy("comment_id").agg(F.min("id").alias("id"))


# H: aggregates -----------------------------------------------------------------------------------------------------------------


@query("h1_counts", cte("comments", "analyses", "contents", "authors") + """SELECT 'comments' AS entity, platform, count(*) AS n FROM comments GROUP BY platform UNION ALL
SELECT 'contents', platform, count(*) FROM contents GROUP BY platform UNION ALL SELECT 'authors', platform, count(*) FROM authors GROUP BY platform UNION ALL
SELECT 'analyses', c.platform, count(*) FROM analyses a JOIN comments c ON a.comment_id = c.comment_id GROUP BY c.platform""")  # fmt: skip
def h1(spark, sf_dir):
    comments, analyses = _two(spark, sf_dir)
    tables = {"comments": comments, "contents": view(spark, sf_dir, "contents"), "authors": view(spark, sf_dir, "authors"), "analyses": analyses.select("comment_id").join(comments.select("comment_id", "platform"), "comment_id")}
    out = None
    for name, df in tables.items():
        n = df.groupBy("platform").agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "platform", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("h2_comment_statistics", cte("comments") + """SELECT count(*) AS comments, count(*) FILTER (depth = 0) AS roots, count(*) FILTER (depth > 0) AS replies,
min(published_at) AS first_at, max(published_at) AS last_at FROM comments WHERE platform = 'bilibili'""")  # fmt: skip
def h2(spark, sf_dir):
    return O.comment_statistics(O.in_scope(view(spark, sf_dir, "comments"), "bilibili"))


@query("h3_run_statistics", cte("comments", "contents") + """, people AS (SELECT run_id, author_id FROM comments UNION SELECT run_id, author_id FROM contents)
SELECT run_id, c.comments, c.roots, c.replies, t.contents, p.authors
FROM (SELECT run_id, count(*) AS comments, count(*) FILTER (depth = 0) AS roots, count(*) FILTER (depth > 0) AS replies FROM comments GROUP BY run_id) c
JOIN (SELECT run_id, count(*) AS contents FROM contents GROUP BY run_id) t USING (run_id) JOIN (SELECT run_id, count(*) AS authors FROM people GROUP BY run_id) p USING (run_id)""")  # fmt: skip
def h3(spark, sf_dir):
    return O.run_statistics(view(spark, sf_dir, "comments"), view(spark, sf_dir, "contents"))


@query("h4_coverage", CA + "SELECT count(*) AS total, count(k.comment_id) AS analyzed FROM comments c LEFT JOIN (SELECT DISTINCT comment_id FROM analyses) k ON c.comment_id = k.comment_id")
def h4(spark, sf_dir):
    return O.coverage(*_two(spark, sf_dir))


_DIST = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM latest), 2) AS percentage FROM latest GROUP BY {d}" for d in O.DIMENSIONS
)


@query("h5_distribution", CAL + _DIST)
def h5(spark, sf_dir):
    return O.distribution(_latest(spark, sf_dir))


@query("h6_score_statistics", CAL + "SELECT min(sentiment_score) AS min_score, max(sentiment_score) AS max_score, round(avg(sentiment_score), 4) AS mean_score FROM latest")
def h6(spark, sf_dir):
    return O.score_statistics(_latest(spark, sf_dir))


def _frequency_sql(column: str, k: int) -> str:
    return CAL + f"SELECT value, count(*) AS count FROM (SELECT unnest({column}) AS value FROM latest) x WHERE trim(value) <> '' GROUP BY value ORDER BY count DESC, value LIMIT {k}"


def _frequency(column: str, k: int):
    return lambda spark, sf_dir: O.frequency(_latest(spark, sf_dir), column, k)


for _column in ("topics", "keywords", "risk_reasons"):
    query(f"h7_frequency_{_column}", _frequency_sql(_column, 8))(_frequency(_column, 8))


def _breakdown_sql(dimension: str, k: int) -> str:
    return CAL + f""", pairs AS (SELECT topic, value FROM (SELECT unnest(topics) AS topic, {dimension} AS value FROM latest) x WHERE topic <> ''),
top AS (SELECT topic FROM pairs GROUP BY topic ORDER BY count(*) DESC, topic LIMIT {k})
SELECT topic, value, count(*) AS count FROM pairs WHERE topic IN (SELECT topic FROM top) GROUP BY topic, value"""  # fmt: skip


def _breakdown(dimension: str, k: int):
    return lambda spark, sf_dir: O.topic_breakdown(_latest(spark, sf_dir), dimension, k)


for _column in ("sentiment", "risk_level"):
    query(f"h8_topic_by_{_column}", _breakdown_sql(_column, 5))(_breakdown(_column, 5))


@query("h9_volume_by_date", cte("comments") + "SELECT CAST(CAST(published_at AS DATE) AS VARCHAR) AS day, count(*) AS comments FROM comments WHERE published_at IS NOT NULL GROUP BY CAST(published_at AS DATE)")
def h9(spark, sf_dir):
    return O.volume_by_date(view(spark, sf_dir, "comments")).withColumn("day", F.col("day").cast("string"))


def trend_sql(bucket: str) -> str:
    """CTEs up to ``points``: trend buckets with their measures."""
    return CAL + f""", buckets AS (SELECT date_trunc('{bucket}', c.published_at) AS bucket_start, count(*) AS total_comments, count(l.comment_id) AS analyzed_comments,
  count(*) FILTER (sentiment = 'positive') AS positive_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count, count(*) FILTER (sentiment = 'negative') AS negative_count,
  count(*) FILTER (risk_level = 'low') AS low_risk_count, count(*) FILTER (risk_level = 'medium') AS medium_risk_count, count(*) FILTER (risk_level = 'high') AS high_risk_count,
  round(avg(sentiment_score), 4) AS mean_sentiment_score
  FROM comments c LEFT JOIN latest l ON c.comment_id = l.comment_id WHERE c.published_at IS NOT NULL GROUP BY 1),
points AS (SELECT *, round(analyzed_comments / total_comments, 4) AS coverage,
  CASE WHEN analyzed_comments > 0 THEN round(negative_count / analyzed_comments, 4) ELSE 0.0 END AS negative_ratio,
  CASE WHEN analyzed_comments > 0 THEN round(high_risk_count / analyzed_comments, 4) ELSE 0.0 END AS high_risk_ratio,
  CASE WHEN analyzed_comments > 0 THEN round(least(100.0, greatest(0.0, (50 * negative_count + 35 * high_risk_count + 15 * medium_risk_count) / analyzed_comments)), 2) ELSE 0.0 END AS risk_score
  FROM buckets)
"""  # fmt: skip


@query("h10_trend_day", trend_sql("day") + "SELECT * FROM buckets")
def h10_day(spark, sf_dir):
    return O.trend(*_two(spark, sf_dir), "day")


@query("h10_trend_hour", trend_sql("hour") + "SELECT * FROM buckets")
def h10_hour(spark, sf_dir):
    return O.trend(*_two(spark, sf_dir), "hour")


@query("h11_trend_measures", trend_sql("hour") + "SELECT bucket_start, coverage, negative_ratio, high_risk_ratio, risk_score FROM points")
def h11(spark, sf_dir):
    return O.trend_measures(O.trend(*_two(spark, sf_dir), "hour")).select("bucket_start", "coverage", "negative_ratio", "high_risk_ratio", "risk_score")


_SUMMARY = """SELECT CAST(sum(total_comments) AS BIGINT) AS total_comments, CAST(sum(analyzed_comments) AS BIGINT) AS analyzed_comments, round(sum(analyzed_comments) / sum(total_comments), 4) AS analysis_coverage,
CASE WHEN sum(analyzed_comments) / sum(total_comments) < 0.8 THEN 'partial' ELSE 'sufficient' END AS data_quality,
round((50 * sum(negative_count) + 35 * sum(high_risk_count) + 15 * sum(medium_risk_count)) / sum(analyzed_comments), 2) AS overall_risk_score,
(SELECT bucket_start FROM points ORDER BY risk_score DESC, bucket_start DESC LIMIT 1) AS peak_risk_at FROM points"""


@query("h12_trend_summary", trend_sql("day") + _SUMMARY)
def h12(spark, sf_dir):
    return O.trend_summary(O.trend_measures(O.trend(*_two(spark, sf_dir), "day")))


def inflection_sql(bucket: str, least: int, most: int) -> str:
    seconds = {"hour": 3600, "day": 86400}[bucket] * 1.5
    return trend_sql(bucket) + f""", base AS (SELECT greatest(median(total_comments), 1.0) AS base FROM points),
pairs AS (SELECT bucket_start, total_comments, epoch(bucket_start) - epoch(lag(bucket_start) OVER o) AS gap, lag(total_comments) OVER o AS was,
  round(risk_score - lag(risk_score) OVER o, 2) AS score_delta FROM points WINDOW o AS (ORDER BY bucket_start)),
near AS (SELECT *, round((total_comments - was) / greatest(was, 1), 4) AS ratio FROM pairs, base WHERE gap <= {seconds} AND total_comments >= {least}),
kinds AS (SELECT *, CASE WHEN score_delta >= 15 THEN 'risk_spike' WHEN score_delta <= -15 THEN 'recovery'
  WHEN total_comments >= greatest({least}, 3 * base) AND total_comments - was >= greatest(5, 2 * base) AND ratio >= 0.5 THEN 'volume_surge' END AS kind FROM near),
sized AS (SELECT *, CASE WHEN kind = 'volume_surge' THEN ratio * 20 ELSE abs(score_delta) END AS size,
  row_number() OVER (ORDER BY greatest(abs(score_delta), abs(ratio) * 20) DESC, bucket_start) AS rn FROM kinds WHERE kind IS NOT NULL)
SELECT bucket_start, kind, CASE WHEN size >= 30 THEN 'high' WHEN size >= 15 THEN 'medium' ELSE 'low' END AS severity, score_delta, ratio AS volume_change_ratio FROM sized WHERE rn <= {most}"""  # fmt: skip


@query("i4_inflections_hour", inflection_sql("hour", 3, 100000))
def i4(spark, sf_dir):
    return O.inflections(O.trend_measures(O.trend(*_two(spark, sf_dir), "hour")), "hour", 3, 100000)


@query("i5_inflections_capped", inflection_sql("hour", 3, 20))
def i5(spark, sf_dir):
    return O.inflections(O.trend_measures(O.trend(*_two(spark, sf_dir), "hour")), "hour", 3, 20)


_FREQ = "SELECT '{c}' AS section, value AS key, NULL AS subkey, CAST(count(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS percentage FROM (SELECT unnest({c}) AS value FROM latest) x WHERE trim(value) <> '' GROUP BY value ORDER BY n DESC, key LIMIT 10"
_CROSS = """SELECT 'topic_{d}' AS section, topic AS key, value AS subkey, CAST(count(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS percentage FROM (SELECT unnest(topics) AS topic, {d} AS value FROM latest) x
WHERE topic <> '' AND topic IN (SELECT topic FROM (SELECT unnest(topics) AS topic FROM latest) y WHERE topic <> '' GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 10) GROUP BY topic, value"""
_SUMMARY_SQL = CAL + f""", cover AS (SELECT count(*) AS total, count(k.comment_id) AS analyzed FROM comments c LEFT JOIN (SELECT DISTINCT comment_id FROM analyses) k ON c.comment_id = k.comment_id)
SELECT 'coverage' AS section, CASE WHEN analyzed = 0 THEN 'no_analyses' WHEN analyzed < total THEN 'partial' ELSE 'complete' END AS key, CAST(NULL AS VARCHAR) AS subkey, CAST(analyzed AS DOUBLE) AS n, round(100.0 * analyzed / total, 2) AS percentage FROM cover
UNION ALL SELECT 'score', 'mean', NULL, round(avg(sentiment_score), 4), NULL FROM latest
UNION ALL SELECT 'high_risk', 'high', NULL, count(*) FILTER (risk_level = 'high'), NULL FROM latest
UNION ALL SELECT 'distribution', dimension, value, count, percentage FROM ({_DIST}) z
UNION ALL SELECT 'volume', CAST(CAST(published_at AS DATE) AS VARCHAR), NULL, count(*), NULL FROM comments WHERE published_at IS NOT NULL GROUP BY CAST(published_at AS DATE)
UNION ALL """ + " UNION ALL ".join([f"SELECT * FROM ({_FREQ.format(c=c)}) f_{c}" for c in ("topics", "keywords", "risk_reasons")] + [_CROSS.format(d=d) for d in ("sentiment", "risk_level")])  # fmt: skip


@query("h13_opinion_summary", _SUMMARY_SQL)
def h13(spark, sf_dir):
    return O.opinion_summary(*_two(spark, sf_dir))


@query("h16_snapshot_hash", cte("texts") + "SELECT content_id, hash AS snapshot_hash FROM (" + digest_sql("texts", "content_id", "concat(CAST(comment_id AS VARCHAR), ':', sha256(text))") + ") x")
def h16(spark, sf_dir):
    t = view(spark, sf_dir, "texts").select("content_id", F.col("comment_id").alias("id"), F.sha2("text", 256).alias("h"))
    return O.tree_hash(t, "content_id", "id", "h").withColumnRenamed("hash", "snapshot_hash")


_UUID = f"(SELECT content_id, {UUID_SQL} AS id, sha256(text) AS t FROM (SELECT *, sha1({URL_BYTES} || encode('plaza:' || platform || ':comment:' || CAST(comment_id AS VARCHAR))) AS h FROM texts) y)"


@query("h16_uuid_snapshot", cte("texts") + "SELECT content_id, n, hash FROM (" + digest_sql(_UUID + " z", "content_id", "concat(id, ':', t)") + ") x")
def h16_uuid(spark, sf_dir):
    """The same over the library's own ids."""
    t = view(spark, sf_dir, "texts")
    ids = F.when(F.col("platform") == "douyin", S.entity_id("douyin", "comment", F.col("comment_id").cast("string"))).otherwise(S.entity_id("bilibili", "comment", F.col("comment_id").cast("string")))
    return set_digest(t.select("content_id", ids.alias("id"), F.sha2("text", 256).alias("t")), ["content_id"], F.concat_ws(":", "id", "t"))


@query("h17_cost_totals", cte("texts") + """, t AS (SELECT content_id, greatest(1, CAST(ceil(len(regexp_extract_all(text, '\\S')) / 4) AS INT)) AS tokens FROM texts)
SELECT content_id, CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(count(*) * 120 AS BIGINT) AS output_tokens, round((sum(tokens) * 0.5 + count(*) * 120 * 1.5) / 1000000, 6) AS cost FROM t GROUP BY content_id""")  # fmt: skip
def h17(spark, sf_dir):
    from plaza.operators import labeling as L

    t = view(spark, sf_dir, "texts").select("content_id", S.token_estimate(F.col("text")).alias("input_tokens"), F.lit(120).alias("output_tokens"))
    return L.cost_totals(t, ["content_id"], 0.5, 1.5)


@query("h18_latency_totals", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS requests, round(avg(value), 4) AS mean_latency, max(value) FILTER (rn = greatest(1, CAST(floor(n * 0.95) AS BIGINT))) AS p95_latency FROM r GROUP BY event_type""")  # fmt: skip
def h18(spark, sf_dir):
    from plaza.operators import labeling as L

    return L.latency_totals(load(spark, sf_dir, "events"), "event_type", "value", "event_id")


# I: windows --------------------------------------------------------------------------------------------------------------------

_LATEST_COLUMNS = ["comment_id", "id", "created_at", "sentiment", "risk_level", "model"]


@query("i1_latest_analysis", CAL + f"SELECT {', '.join(_LATEST_COLUMNS)} FROM latest")
def i1(spark, sf_dir):
    return _latest(spark, sf_dir).select(*_LATEST_COLUMNS)


@query("i2_latest_for_ids", CAL + "SELECT comment_id, id FROM latest WHERE comment_id IN (SELECT c_custkey FROM customer)")
def i2(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("comment_id"))
    return O.latest(view(spark, sf_dir, "analyses"), O.by_ids(view(spark, sf_dir, "comments"), "comment_id", ids.select(F.col("comment_id").alias("id"), F.lit(0).alias("position")))).select("comment_id", "id")


@query("i3_first_cached", CA + "SELECT input_hash, model, id FROM (SELECT *, row_number() OVER (PARTITION BY input_hash, model ORDER BY created_at, id) AS rn FROM analyses) x WHERE rn = 1")
def i3(spark, sf_dir):
    return O.first_cached(view(spark, sf_dir, "analyses"), ["input_hash", "model"]).select("input_hash", "model", "id")


@query("i6_round_robin", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('seed:', doc_id)), doc_id) AS turn FROM documents)
SELECT doc_id, source, turn, row_number() OVER (ORDER BY turn, source) AS position FROM r""")  # fmt: skip
def i6(spark, sf_dir):
    from plaza.operators import sampling as P

    return P.round_robin(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.sha2(F.concat(F.lit("seed:"), F.col("doc_id")), 256), "doc_id")


@query("i7_keyword_day_cap", """WITH r AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS a FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day, a) AS b FROM r WHERE a <= 5) SELECT event_id, event_type, CAST(day AS VARCHAR) AS day FROM s WHERE b <= 60""")  # fmt: skip
def i7(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.to_date("ts").alias("day"))
    daily = O.capped(e, ["event_type", "day"], [F.col("ts"), F.col("event_id")], 5)
    return O.capped(daily, ["event_type"], [F.col("day"), F.col("ts"), F.col("event_id")], 60).select("event_id", "event_type", F.col("day").cast("string").alias("day"))


@query("i8_content_cap", cte("comments") + "SELECT comment_id, content_id FROM (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY published_at ASC NULLS LAST, comment_id) AS rn FROM comments) x WHERE rn <= 10")
def i8(spark, sf_dir):
    return O.capped(view(spark, sf_dir, "comments"), ["content_id"], [F.col("published_at").asc_nulls_last(), F.col("comment_id")], 10).select("comment_id", "content_id")


@query("i9_keep_first_text", cte("texts") + "SELECT min(comment_id) AS comment_id, sha256(lower(text)) AS text_key FROM texts GROUP BY lower(text)")
def i9(spark, sf_dir):
    t = view(spark, sf_dir, "texts").select("comment_id", F.sha2(F.lower("text"), 256).alias("text_key"))
    return O.keep_first_text(t, F.col("text_key"), [F.col("comment_id")])


@query("i10_min_max_within", cte("comments") + """, l AS (SELECT comment_id, content_id, ln(1 + greatest(coalesce(like_count, 0), 0)) AS x FROM comments),
m AS (SELECT *, min(x) OVER (PARTITION BY content_id) AS lo, max(x) OVER (PARTITION BY content_id) AS hi FROM l)
SELECT comment_id, round(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.0 END, 9) AS engagement FROM m""")  # fmt: skip
def i10(spark, sf_dir):
    return O.min_max_within(view(spark, sf_dir, "comments"), "content_id", "like_count", "engagement").select("comment_id", F.round("engagement", 9).alias("engagement"))


# J: joins ----------------------------------------------------------------------------------------------------------------------


@query("j1_analyses_of_comments", CA + "SELECT a.id, c.comment_id, c.platform, a.sentiment FROM analyses a JOIN comments c ON a.comment_id = c.comment_id")
def j1(spark, sf_dir):
    comments, analyses = _two(spark, sf_dir)
    return analyses.select("id", "comment_id", "sentiment").join(comments.select("comment_id", "platform"), "comment_id")


@query("j2_comments_left_latest", CAL + "SELECT c.comment_id, l.id, l.risk_level FROM comments c LEFT JOIN latest l ON c.comment_id = l.comment_id")
def j2(spark, sf_dir):
    comments, analyses = _two(spark, sf_dir)
    return comments.select("comment_id").join(O.latest(analyses, columns=["risk_level"]), "comment_id", "left").select("comment_id", "id", "risk_level")


@query("j3_snapshot", CAL + "SELECT c.comment_id, e.vec_id, l.id AS analysis_id FROM comments c LEFT JOIN embeddings e ON e.vec_id = c.comment_id LEFT JOIN latest l ON l.comment_id = c.comment_id WHERE c.platform = 'douyin'")
def j3(spark, sf_dir):
    comments, analyses = _two(spark, sf_dir)
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("comment_id"))
    newest = O.latest(analyses, columns=[]).select("comment_id", F.col("id").alias("analysis_id"))
    return O.in_scope(comments, "douyin").select("comment_id").join(vectors, "comment_id", "left").join(newest, "comment_id", "left")


@query("j4_unnest", CA + "SELECT id, unnest(topics) AS topic FROM analyses")
def j4(spark, sf_dir):
    return view(spark, sf_dir, "analyses").select("id", F.explode("topics").alias("topic"))


@query("j5_semi_anti", cte("comments", "contents") + """SELECT comment_id, EXISTS (SELECT 1 FROM contents t WHERE t.content_id = c.content_id AND t.platform = c.platform) AS known FROM comments c""")
def j5(spark, sf_dir):
    good, bad = O.existing(view(spark, sf_dir, "comments"), view(spark, sf_dir, "contents"))
    return good.select("comment_id", F.lit(True).alias("known")).union(bad.select("comment_id", F.lit(False)))


@query("j7_author_lookup", "SELECT o_orderkey, c_name AS author FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j7(spark, sf_dir):
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author"))
    return load(spark, sf_dir, "orders").join(people, "o_custkey", "left").select("o_orderkey", "author")


@query("j8_annotations", CAL + "SELECT g.doc_id, g.toxic, l.risk_level FROM labels g LEFT JOIN latest l ON l.comment_id = g.doc_id")
def j8(spark, sf_dir):
    newest = _latest(spark, sf_dir).select(F.col("comment_id").alias("doc_id"), "risk_level")
    return load(spark, sf_dir, "labels").select("doc_id", "toxic").join(newest, "doc_id", "left")


# N, O: top-k and sets ----------------------------------------------------------------------------------------------------------


@query("n3_high_risk", CAL + "SELECT c.comment_id, c.like_count, c.published_at FROM comments c JOIN latest l ON c.comment_id = l.comment_id WHERE l.risk_level = 'high' ORDER BY c.like_count DESC NULLS LAST, c.published_at DESC NULLS LAST, c.comment_id LIMIT 25")
def n3(spark, sf_dir):
    return O.high_risk(*_two(spark, sf_dir), limit=25).select("comment_id", "like_count", "published_at")


@query("n4_topics_by_size", "SELECT label, count(*) AS size, min(vec_id) AS medoid FROM embeddings GROUP BY label ORDER BY size DESC, medoid LIMIT 10")
def n4(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("medoid")).orderBy(F.desc("size"), "medoid").limit(10)


@query("o1_distinct_authors", cte("comments", "contents") + "SELECT author_id FROM comments UNION SELECT author_id FROM contents")
def o1(spark, sf_dir):
    return view(spark, sf_dir, "comments").select("author_id").union(view(spark, sf_dir, "contents").select("author_id")).distinct()


@query("o2_ordered_distinct", "SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY l_partkey")
def o2(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))


@query("o3_disjoint", "SELECT count(*) AS shared FROM (SELECT vec_id FROM embeddings WHERE label % 2 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE label % 3 = 0) x")
def o3(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.where("label % 2 = 0").select("vec_id").intersect(e.where("label % 3 = 0").select("vec_id")).agg(F.count("*").alias("shared"))


@query("o4_union_platforms", cte("contents", "comments") + "SELECT platform, content_id AS id, 'content' AS kind FROM contents UNION ALL SELECT platform, comment_id, 'comment' FROM comments")
def o4(spark, sf_dir):
    a = view(spark, sf_dir, "contents").select("platform", F.col("content_id").alias("id"), F.lit("content").alias("kind"))
    return a.unionByName(view(spark, sf_dir, "comments").select("platform", F.col("comment_id").alias("id"), F.lit("comment").alias("kind")))


@query("h23_word_frequency", """SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) x WHERE word NOT IN ('the', 'of') GROUP BY word ORDER BY count DESC, word LIMIT 20""")
def h23(spark, sf_dir):
    return O.word_frequency(F.col("text"), load(spark, sf_dir, "documents"), ["the", "of"])


