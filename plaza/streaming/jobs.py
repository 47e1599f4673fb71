"""Structured Streaming over the growing landing folder: ingest, live volumes, touched trend buckets, alerts, request rates and labelling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from plaza.operators import labeling as L
from plaza.operators import merge as U
from plaza.operators import opinion as O
from plaza.operators.merge_log import LogTable


def landing_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New files of a landing folder. Files are read once, so writers add files and never append to them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).format(fmt).load(path)


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Drops repeats that arrive within ``delay``; the keyed merge catches later ones."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str, keep_if_null: bool = False, buckets: int = 64, newest_wins: bool = False) -> StreamingQuery:
    """Merges each micro-batch into the Parquet table at ``target``, which is partitioned by a hash of the key into ``buckets``.

    Only the partitions that a batch touches are rewritten, so a table takes as many buckets as keep one to some 100 MB; the number
    belongs to the table and does not change. With ``newest_wins`` rows that are older than the stored one of their key (by ``order``)
    are passed over, whatever the order of arrival; else the batch wins. A batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = U.last_wins(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in held.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if touched:
                stored, rows = read_table(spark, target, held.schema).where(F.col("bucket").isin(touched)), held
                if newest_wins:
                    known = stored.select(*key, F.struct(*order).alias("_stored"))
                    rows = rows.join(known, key, "left").where(F.col("_stored").isNull() | (F.struct(*order) >= F.col("_stored"))).select(*stored.columns)
                merged = U.upsert(stored, rows, [*key, "bucket"], default=U.KEEP_IF_NULL if keep_if_null else U.OVERWRITE)
                U.replace_partitions(merged, target, "bucket")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_log(stream: DataFrame, table: LogTable, checkpoint: str, ratio: float = 0.5) -> StreamingQuery:
    """Merges each micro-batch into a merge log: it writes the batch's rows, and now and then a new base. The newest row of a key wins."""

    def merge(batch: DataFrame, number: int) -> None:
        table.compact(number, ratio)
        table.append(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not be there yet."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def live_volume(stream: DataFrame, time: str = "published_at", bucket: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Comments per window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, bucket).alias("w")).agg(F.count("*").alias("comments")).select(F.col("w.start").alias("bucket_start"), "comments")


def _struct(columns: str) -> T.StructType:
    out = T.StructType()
    for c in columns.split(", "):
        out = out.add(*c.split())
    return out


#: What a stream of comments and labels has: a comment row has a time of publication, a label row an id and a time of creation.
FACTS = _struct("comment_id long, published_at timestamp, id long, created_at timestamp, sentiment string, risk_level string, sentiment_score double")
_COUNTS = "total_comments analyzed_comments positive_count neutral_count negative_count low_risk_count medium_risk_count high_risk_count scored".split()
_TREND = _struct("bucket_start timestamp, " + ", ".join(f"{c} long" for c in _COUNTS) + ", score_sum decimal(38,12), batch long")
_ALERT = _struct("bucket_start timestamp, active boolean, kind string, severity string, score_delta double, volume_change_ratio double, batch long")


class LiveTrend:
    """Trend buckets and their inflections, kept up to date by a stream of comments and labels that come in any order.

    What is known of each comment is kept in merge logs. A batch changes the state of its comments; the differences, by bucket, are added to the stored buckets,
    so only touched buckets are written. Inflections of the new buckets (one row an hour or day, so few) are compared with the stored ones: a new or
    changed one is written as active, one that no longer holds as not active. A batch that is run again starts from the state before it.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, bucket: str = "hour", least: int = 10, buckets: int = 16):
        pick = lambda names: T.StructType([f for f in FACTS if f.name in names])
        table = lambda of, schema, key, order: LogTable(spark, f"{name}_{of}", f"{path}/{of}", schema, [key], order, buckets)
        self.bucket, self.least = bucket, least
        self.comments = table("comments", pick(["comment_id", "published_at"]), "comment_id", ["published_at"])
        self.labels = table("labels", pick([f.name for f in FACTS if f.name != "published_at"]), "comment_id", ["created_at", "id"])
        self.trend, self.alerts = table("trend", _TREND, "bucket_start", ["batch"]), table("alerts", _ALERT, "bucket_start", ["batch"])

    def _added(self, ids: DataFrame, before: int, sign: int) -> DataFrame:
        """What the comments of ``ids`` add to their buckets, as known before a batch."""
        known = self.comments.read(before).join(ids, "comment_id", "left_semi").where("published_at is not null")
        both = known.join(self.labels.read(before).join(ids, "comment_id", "left_semi"), "comment_id", "left")
        has = lambda c, v: (F.col(c) == v).cast("int")
        flags = [F.lit(1), F.col("id").isNotNull().cast("int"), *[has("sentiment", v) for v in ("positive", "neutral", "negative")], *[has("risk_level", v) for v in ("low", "medium", "high")], F.col("sentiment_score").isNotNull().cast("int")]
        counts = [(sign * F.coalesce(x, F.lit(0))).alias(c) for x, c in zip(flags, _COUNTS, strict=True)]
        return both.select(F.date_trunc(self.bucket, "published_at").alias("bucket_start"), *counts, (sign * F.coalesce("sentiment_score", F.lit(0.0)).cast("decimal(20,12)")).alias("score_sum"))

    def update(self, batch: DataFrame, number: int) -> None:
        for table in (self.comments, self.labels, self.trend, self.alerts):
            table.compact(number)
        batch = batch.persist()
        try:
            ids = batch.select("comment_id").distinct()
            self.comments.append(batch.where("published_at is not null"), number)
            self.labels.append(batch.where("id is not null"), number)
            change = self._added(ids, number + 1, 1).unionByName(self._added(ids, number, -1))
            sums = [F.sum(c).cast(_TREND[c].dataType).alias(c) for c in (*_COUNTS, "score_sum")]
            change = change.groupBy("bucket_start").agg(*sums).where(" or ".join(f"{c} <> 0" for c in (*_COUNTS, "score_sum")))
            old = self.trend.read(number).select("bucket_start", *_COUNTS, "score_sum")
            touched = change.unionByName(old.join(change, "bucket_start", "left_semi")).groupBy("bucket_start").agg(*sums)
            self.trend.append(touched.withColumn("batch", F.lit(number).cast("bigint")), number)
            self._compare(number)
        finally:
            batch.unpersist()

    def _compare(self, number: int) -> None:
        points = O.trend_measures(self.buckets(number + 1))
        now = O.inflections(points, self.bucket, self.least, most=None).select("bucket_start", F.struct(F.lit(True).alias("active"), "kind", "severity", "score_delta", "volume_change_ratio").alias("now"))
        was = self.alerts.read(number).where("active").select("bucket_start", F.struct("active", "kind", "severity", "score_delta", "volume_change_ratio").alias("was"))
        both = now.join(was, "bucket_start", "full").where(~F.col("now").eqNullSafe(F.col("was")))
        row = F.coalesce("now", F.struct(F.lit(False).alias("active"), "was.kind", "was.severity", "was.score_delta", "was.volume_change_ratio"))
        self.alerts.append(both.select("bucket_start", row.alias("row")).select("bucket_start", "row.*", F.lit(number).cast("bigint").alias("batch")), number)

    def buckets(self, before: int | None = None) -> DataFrame:
        """The trend as ``opinion.trend`` gives it."""
        x = self.trend.read(before).where("total_comments > 0")
        mean = F.round(F.when(F.col("scored") > 0, F.col("score_sum").cast("double") / F.col("scored")), 4)
        return x.select("bucket_start", *[c for c in _COUNTS if c != "scored"], mean.alias("mean_sentiment_score"))

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched_buckets(batch: DataFrame, comments: DataFrame, bucket: str = "day") -> DataFrame:
    """The trend buckets that a batch of comments or analyses (comment_id) touches."""
    return comments.join(batch.select("comment_id").distinct(), "comment_id", "left_semi").where("published_at is not null").select(F.date_trunc(bucket, "published_at").alias("bucket_start")).distinct()


def refreshed_trend(trend: DataFrame, batch: DataFrame, comments: DataFrame, analyses: DataFrame, bucket: str = "day") -> DataFrame:
    """``trend`` with the touched buckets computed again from the merged tables; the others are taken over."""
    touched = touched_buckets(batch, comments, bucket)
    again = comments.join(touched, F.date_trunc(bucket, "published_at") == F.col("bucket_start"), "left_semi")
    fresh = O.trend(again, analyses.join(again.select("comment_id"), "comment_id", "left_semi"), bucket)
    return trend.join(touched, "bucket_start", "left_anti").unionByName(fresh)


def alerts(points: DataFrame, touched: DataFrame, bucket: str, least: int) -> DataFrame:
    """Inflections at touched buckets and at the ones right after them."""
    found = O.inflections(points, bucket, least, most=None)
    step = F.expr(f"interval 1 {bucket}")
    near = touched.select("bucket_start").union(touched.select((F.col("bucket_start") + step).alias("bucket_start"))).distinct()
    return found.join(near, "bucket_start", "left_semi")


def request_rate(stream: DataFrame, time: str, limit: int, span: str = "60 seconds", slide: str = "1 second", delay: str = "5 minutes") -> DataFrame:
    """Sliding windows with more requests than ``limit``."""
    windows = stream.withWatermark(time, delay).groupBy(F.window(time, span, slide).alias("w")).agg(F.count("*").alias("requests"))
    return windows.where(F.col("requests") > limit).select(F.col("w.end").alias("at"), "requests")


def trailing_rate(rows: DataFrame, key: list[str], time: str, seconds: int = 60, slot: int = 3600) -> DataFrame:
    """``rows`` with ``requests``: how many rows of their key are in the last ``seconds`` up to and with each.

    Time is cut into slots of ``slot`` seconds, and the rows at the end of a slot are carried over into the next as its edge, so a busy key is spread over
    many tasks, and no window is longer than a slot and its edge. Rows without a time or key stay, with null or as one key.
    """
    if seconds > slot:
        raise ValueError("a slot is at least as long as the span")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    at, length, span = F.col("_at"), slot * 1_000_000, seconds * 1_000_000
    x = rows.withColumn("_at", micros).withColumn("_slot", F.floor(at / length))
    edge = x.where(at >= (F.col("_slot") + 1) * length - span + 1).withColumns({"_slot": F.col("_slot") + 1, "_edge": F.lit(True)})
    both = x.withColumn("_edge", F.lit(False)).unionByName(edge)
    window = Window.partitionBy(*key, "_slot").orderBy("_at").rangeBetween(1 - span, 0)
    return both.withColumn("requests", F.when(at.isNotNull(), F.count("*").over(window))).where(~F.col("_edge")).drop("_at", "_slot", "_edge")


def label_stream(stream: DataFrame, analyses_path: str, schema: T.StructType, model: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], buckets: int = 64) -> StreamingQuery:
    """Labels the new comments of each micro-batch that have no analysis yet and adds rows; ``label`` adds ``output`` to texts.

    The table of analyses is partitioned by a hash of the text's hash into ``buckets``, and a batch reads those that it touches and writes a file to each.
    """
    placed = F.pmod(F.xxhash64("input_hash"), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, _: int) -> None:
        touched = [r[0] for r in batch.select(placed).distinct().collect()]  # at most ``buckets`` numbers
        stored = read_table(batch.sparkSession, analyses_path, T.StructType([*schema, T.StructField("bucket", T.IntegerType())]))
        known = stored.where(F.col("bucket").isin(touched)).select(*schema.names)
        _, copied, todo = L.select_work(batch, known, model)
        made = L.fan_out(L.validate_labels(label(todo)), batch, model)
        rest = made.withColumn("created_at", F.current_timestamp()).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        old = known.withColumnsRenamed({c: f"_{c}" for c in ("comment_id", "input_hash", "id")})
        reused = copied.join(old, F.col("source_id") == F.col("_id")).drop("_comment_id", "_input_hash", "_id", "source_id", "text")
        reused = reused.withColumn("id", L.analysis_id(model)).select(*[F.col(f.name).cast(f.dataType) for f in schema])
        new = rest.unionByName(reused).join(known.select("comment_id", "input_hash"), ["comment_id", "input_hash"], "left_anti").select(*schema.names, placed.alias("bucket"))
        new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(analyses_path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
