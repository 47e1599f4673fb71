"""Streaming jobs over the given tables, run to the end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plaza.operators import opinion as O
from plaza.operators.merge_log import LogTable
from plaza.plans.opinion_queries import inflection_sql, trend_sql
from plaza.plans.record_queries import URL_BYTES, UUID_SQL
from plaza.plans.registry import load, query
from plaza.plans.views import cte, view
from plaza.sources.paths import fresh
from plaza.streaming import jobs as J


def _landed(spark, sf_dir, name, df, parts: int = 4, rows: int = 200_000):
    """The rows as landing files of a bounded number of rows, and a stream that takes half of the files at a time."""
    path = fresh(spark, name)
    files = max(parts, -(-df.count() // rows))
    df.repartition(files).write.parquet(path)
    return J.landing_stream(spark, path, df.schema, "parquet", -(-files // 2))


@query("p1_streaming_ingest", "SELECT l_orderkey AS id, max(l_linenumber) AS rev, CAST(arg_max(l_extendedprice, l_linenumber * 1000000000.0 + l_extendedprice) AS DOUBLE) AS price FROM lineitem GROUP BY l_orderkey")
def p1(spark, sf_dir):
    """All versions of each order arrive in several batches and any order; the newest stays."""
    x = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("rev"), F.col("l_extendedprice").alias("price"))
    target = fresh(spark, "orders")
    for _ in range(2):  # the same files again change nothing
        J.ingest(_landed(spark, sf_dir, "landing", x), target, ["id"], ["rev", "price"], fresh(spark, "ckpt"), buckets=16, newest_wins=True).awaitTermination()
    return spark.read.parquet(target).select("id", "rev", "price")


@query("p1_merge_log", "SELECT conv_id, CAST(max(turn) AS BIGINT) AS turn, arg_max(role, turn) AS role, arg_max(sha256(text), turn) AS text_hash FROM conversations GROUP BY conv_id")
def p1_log(spark, sf_dir):
    """All turns of each conversation arrive in several batches and any order, twice; the last one stays. Batches write their own rows."""
    x = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_hash"))
    table = LogTable(spark, f"turns_{uuid.uuid4().hex}", fresh(spark, "turns"), x.schema, ["conv_id"], ["turn", "role", "text_hash"])
    landing = fresh(spark, "landing")
    x.union(x).repartition(max(8, -(-x.count() // 100_000))).write.parquet(landing)
    J.ingest_log(J.landing_stream(spark, landing, x.schema, "parquet", 3), table, fresh(spark, "ckpt")).awaitTermination()
    return table.read()


@query("p2_replay_dedup", "SELECT event_id FROM events")
def p2(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    stream = J.without_repeats(_landed(spark, sf_dir, "landing", e.union(e)), ["event_id"], "at", "60 days")
    return _sink(spark, stream).select("event_id")


def _sink(spark, stream, mode: str = "append"):
    path = fresh(spark, "sink")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    name = f"t{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/{name}")).option("checkpointLocation", fresh(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


@query("p3_live_volume", cte("comments") + "SELECT date_trunc('hour', published_at) AS bucket_start, count(*) AS comments FROM comments WHERE published_at IS NOT NULL GROUP BY 1")
def p3(spark, sf_dir):
    c = view(spark, sf_dir, "comments").where("published_at is not null").select(F.col("published_at").cast("timestamp").alias("published_at"))
    return _sink(spark, J.live_volume(_landed(spark, sf_dir, "landing", c), delay="90 days"), "complete").withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("p3_late_rows", "WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events) SELECT date_trunc('hour', ts) AS bucket_start, count(*) AS comments FROM events, m GROUP BY 1, w HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= w")
def p3_late(spark, sf_dir):
    """Rows that arrive again after the watermark has passed them are dropped; windows come out once they are closed."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("published_at"))
    path, out, checkpoint = (fresh(spark, x) for x in ("landing", "sink", "ckpt"))

    def run():
        volumes = J.live_volume(J.landing_stream(spark, path, e.schema, "parquet"), delay="1 day")
        volumes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return volumes.schema

    e.write.parquet(path)
    run()
    e.where(F.col("published_at") < F.lit(e.agg(F.max("published_at")).first()[0]) - F.expr("interval 3 days")).write.mode("append").parquet(path)
    return spark.read.schema(run()).parquet(out).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("p3_refreshed_trend", trend_sql("day") + "SELECT * FROM buckets")
def p3b(spark, sf_dir):
    """Half of the labels are there; the other half arrives as a batch, and the touched buckets are computed again."""
    comments, analyses = view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses")
    old, new = analyses.where("id % 2 = 0"), analyses.where("id % 2 = 1")
    return J.refreshed_trend(O.trend(comments, old, "day"), new, comments, analyses, "day")


def _live(spark, sf_dir, bucket, least):
    """Comments and labels as one landing folder, in files of mixed rows: half of the labels come before all else, and the first half of the comments last."""
    c = view(spark, sf_dir, "comments").select("comment_id", F.col("published_at").cast("timestamp").alias("published_at"))
    a = view(spark, sf_dir, "analyses").select("comment_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "sentiment", "risk_level", "sentiment_score")
    landing, rows = fresh(spark, "landing"), lambda df: df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in J.FACTS])
    parts = [rows(a.where("id % 4 = 1")), rows(c.where("comment_id % 3 <> 0")).unionByName(rows(a.where("id % 4 = 2"))), rows(a.where("id % 4 in (0, 3)")).unionByName(rows(c.where("comment_id % 3 = 0")))]
    live = J.LiveTrend(spark, f"live_{uuid.uuid4().hex}", fresh(spark, "live"), bucket, least)
    for part in parts:  # so the files are older in this order
        part.coalesce(4).write.mode("append").parquet(landing)
    live.run(J.landing_stream(spark, landing, J.FACTS, "parquet", 4), fresh(spark, "ckpt")).awaitTermination()
    return live


@query("p3_streamed_trend", trend_sql("day") + "SELECT * FROM buckets")
def p3c(spark, sf_dir):
    """Trend buckets kept up to date by batches of comments and labels in mixed order."""
    return _live(spark, sf_dir, "day", 10).buckets().withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("p4_live_alerts", inflection_sql("hour", 3, 1_000_000_000))
def p4_live(spark, sf_dir):
    """Inflections that a stream adds, changes and takes back as labels arrive; those that stand at its end."""
    found = _live(spark, sf_dir, "hour", 3).alerts.read().where("active")
    return found.select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "kind", "severity", "score_delta", "volume_change_ratio")


@query("p4_alerts", inflection_sql("hour", 3, 1_000_000_000).replace("SELECT bucket_start, kind,", ", touched AS (SELECT DISTINCT date_trunc('hour', c.published_at) AS b FROM analyses a JOIN comments c ON a.comment_id = c.comment_id WHERE a.id % 1000 = 1 AND c.published_at IS NOT NULL) SELECT bucket_start, kind,") + " AND (bucket_start IN (SELECT b FROM touched) OR bucket_start - INTERVAL 1 HOUR IN (SELECT b FROM touched))")
def p4(spark, sf_dir):
    comments, analyses = view(spark, sf_dir, "comments"), view(spark, sf_dir, "analyses")
    points = O.trend_measures(O.trend(comments, analyses, "hour"))
    touched = J.touched_buckets(analyses.where("id % 1000 = 1"), comments, "hour")
    return J.alerts(points, touched, "hour", 3)


@query("p5_request_rate", """SELECT e AS at, count(*) AS requests FROM (SELECT unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE, date_trunc('minute', ts) + INTERVAL 60 MINUTE, INTERVAL 1 MINUTE)) AS e FROM events) x GROUP BY e HAVING count(*) > 15""")
def p5(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at_"))
    rates = J.request_rate(_landed(spark, sf_dir, "landing", e), "at_", 15, "60 minutes", "1 minute", "90 days")
    return _sink(spark, rates, "complete").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("p5_trailing_rate", """SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) AS requests FROM events QUALIFY requests > 1""")
def p5_trailing(spark, sf_dir):
    """Events with another one of their type in the 60 seconds before."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return J.trailing_rate(e, ["event_type"], "ts").where("requests > 1").select("event_id", "event_type", "requests")


@query("p5_sliding_stream", """WITH m AS (SELECT max(ts) - INTERVAL 5 MINUTE AS w FROM events), s AS (SELECT unnest(generate_series(date_trunc('second', ts) + INTERVAL 1 SECOND, date_trunc('second', ts) + INTERVAL 60 SECOND, INTERVAL 1 SECOND)) AS e FROM events)
SELECT e AS at, count(*) AS requests FROM s, m WHERE e <= w GROUP BY e HAVING count(*) > 1""")
def p5_sliding(spark, sf_dir):
    """Windows of 60 seconds, each second, with a watermark of five minutes: those that are closed when the stream has seen all events in the order of time."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at_"))
    landing, (low, high) = fresh(spark, "landing"), e.agg(F.min("at_"), F.max("at_")).first()
    for k in range(3):
        begin, end = (low + (high - low) * j / 3 for j in (k, k + 1))
        e.where((F.col("at_") >= F.lit(begin)) & ((F.col("at_") < F.lit(end)) | F.lit(k == 2))).coalesce(2).write.mode("append").parquet(landing)
    rates = J.request_rate(J.landing_stream(spark, landing, e.schema, "parquet", 2), "at_", 1)
    return _sink(spark, rates).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("p6_label_stream", f"SELECT comment_id, input_hash, {UUID_SQL} AS id FROM (SELECT doc_id AS comment_id, sha256(text) AS input_hash, sha1({URL_BYTES} || encode('plaza:analysis:' || CAST(doc_id AS VARCHAR) || ':' || sha256(text) || ':rules')) AS h FROM documents) x")
def p6(spark, sf_dir):
    from plaza.operators import labeling as L

    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("comment_id"), "text", F.sha2("text", 256).alias("input_hash"))
    path = fresh(spark, "analyses")
    from pyspark.sql import types as T

    schema = T.StructType().add("comment_id", "long").add("input_hash", "string").add("id", "string").add("model", "string").add("created_at", "timestamp").add("sentiment", "string").add("risk_level", "string")
    J.label_stream(_landed(spark, sf_dir, "landing", d, 2), path, schema, "rules", fresh(spark, "ckpt"), lambda x: x.withColumn("output", L.rule_labels(F.col("text")))).awaitTermination()
    return spark.read.parquet(path).select("comment_id", "input_hash", "id")
