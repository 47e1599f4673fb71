"""Batch labelling with reuse by content, its costs and its report."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.functions import scalar as S
from plaza.functions.batches import slices
from plaza.operators.sampling import numbered

LABELS = "sentiment string, sentiment_score double, emotion string, stance string, risk_level string, topics array<string>, risk_reasons array<string>, keywords array<string>, summary string"
# The labels that each dimension may have.
SENTIMENTS = ("positive", "neutral", "negative")
EMOTIONS = ("joy", "anger", "sadness", "fear", "surprise", "disgust", "neutral")
STANCES = ("support", "oppose", "neutral", "unclear")
RISKS = ("low", "medium", "high")

Labeler = Callable[[Sequence[str]], Sequence[str | None]]


def select_work(comments: DataFrame, analyses: DataFrame, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Splits ``comments`` (comment_id, text, input_hash) by what is known of ``model``: (skipped, copied, to label).

    A comment with an analysis of its own text is skipped; one whose text another comment was labelled with gets a copy of the
    oldest; of the rest each distinct text is labelled once.
    """
    known = analyses.where(F.col("model") == model)
    exact = known.select("comment_id", "input_hash").distinct()
    skipped = comments.join(exact, ["comment_id", "input_hash"], "left_semi")
    rest = comments.join(exact, ["comment_id", "input_hash"], "left_anti")
    oldest = Window.partitionBy("input_hash").orderBy("created_at", "id")
    cached = known.withColumn("_rank", F.row_number().over(oldest)).where("_rank = 1").select("input_hash", F.col("id").alias("source_id"))
    copied = rest.join(cached, "input_hash")
    todo = rest.join(cached, "input_hash", "left_anti").groupBy("input_hash").agg(F.min("comment_id").alias("comment_id"), F.min_by("text", "comment_id").alias("text"), F.count("*").alias("comments"))
    return skipped, copied, todo


def rule_labels(text: Column) -> Column:
    """The default labeler: a JSON label by a few fixed words, in the JVM, so that jobs can be run and tested without a model."""
    low = F.lower(text)
    counts = F.struct(
        F.regexp_count(low, F.lit(r"\b(bad|slow|broken|angry|refund|trash|stupid)\b")).alias("bad"), F.regexp_count(low, F.lit(r"\b(good|fast|great|love|nice|thanks)\b")).alias("good"),
        F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z]{9,})"))), 1, 3).alias("topics"), F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z]{7,})"))), 1, 5).alias("keywords"),
        F.substring(F.concat(F.lit("text: "), text), 1, 80).alias("summary"),
    )

    def label(c: Column) -> Column:
        bad, good = c["bad"], c["good"]
        sentiment = F.when(bad > good, "negative").when(good > bad, "positive").otherwise("neutral")
        return F.to_json(
            F.struct(
                sentiment.alias("sentiment"), F.when(bad + good > 0, F.round((good - bad) / (good + bad), 4)).otherwise(0.0).alias("sentiment_score"),
                F.when(bad > good, "anger").when(good > bad, "joy").otherwise("neutral").alias("emotion"), F.when(bad > good, "oppose").when(good > bad, "support").otherwise("neutral").alias("stance"),
                F.when(bad >= 3, "high").when(bad >= 1, "medium").otherwise("low").alias("risk_level"), c["topics"].alias("topics"), F.array().cast("array<string>").alias("risk_reasons"), c["keywords"].alias("keywords"), c["summary"].alias("summary"),
            )
        )

    return S.once(counts, label)


def apply_labeler(work: DataFrame, labeler: Labeler, text: str = "text", retries: int = 2) -> DataFrame:
    """Adds ``output`` (JSON) and ``failure``: ``labeler`` gets texts of an Arrow batch, some hundred at a time; of these, if they fail, the halves down to the bad row."""

    def label(texts: list[str]) -> list[tuple[str | None, str | None]]:
        for attempt in range(retries + 1):
            try:
                return [(x, None if x is not None else "no output") for x in labeler(texts)]
            except Exception as e:
                if attempt == retries:
                    if len(texts) == 1:
                        return [(None, f"{type(e).__name__}: {e}")]
                    half = len(texts) // 2
                    return label(texts[:half]) + label(texts[half:])
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                got = label(part.column(text).to_pylist())
                made = [pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "output", "failure"])

    return work.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in work.dtypes) + ", output string, failure string")


def validate_labels(df: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``label`` (struct) and ``label_error``: the JSON must have exactly the fields of ``LABELS``, within their limits."""
    names = sorted(f.split()[0] for f in LABELS.split(", "))
    inside = lambda c, allowed: c.isNotNull() & c.isin(*allowed)
    short = lambda c, most: c.isNotNull() & (F.size(c) <= most)

    def check(v: Column) -> Column:
        x = v["x"]
        error = (
            F.when(v["keys"].isNull(), "not JSON")
            .when(v["keys"] != F.array(*[F.lit(n) for n in names]), "wrong fields")
            .when(~inside(x["sentiment"], SENTIMENTS), "sentiment")
            .when(x["sentiment_score"].isNull() | ~x["sentiment_score"].between(-1, 1), "sentiment_score")
            .when(~inside(x["emotion"], EMOTIONS), "emotion")
            .when(~inside(x["stance"], STANCES), "stance")
            .when(~inside(x["risk_level"], RISKS), "risk_level")
            .when(~short(x["topics"], 10) | ~short(x["risk_reasons"], 10) | ~short(x["keywords"], 15), "too many values")
            .when(x["summary"].isNull() | ~F.length(x["summary"]).between(1, 200), "summary")
        )
        return F.struct(error.alias("error"), x.alias("x"))

    parsed = F.struct(F.from_json(output, LABELS).alias("x"), F.array_sort(F.json_object_keys(output)).alias("keys"))
    checked = df.withColumn("_checked", S.once(parsed, check))
    out = checked.withColumn("label_error", F.col("_checked.error"))
    return out.withColumn("label", F.when(F.col("_checked.error").isNull(), F.col("_checked.x"))).drop("_checked")


def analysis_id(model: str) -> Column:
    """The id of an analysis of a comment (comment_id, input_hash) by a model, whether it was made or copied."""
    return S.uuid5(F.concat_ws(":", F.lit("plaza:analysis"), F.col("comment_id"), "input_hash", F.lit(model)))


def fan_out(labelled: DataFrame, comments: DataFrame, model: str) -> DataFrame:
    """An analysis row with a deterministic id for every comment of each labelled text."""
    good = labelled.where("label_error is null").select("input_hash", "label.*")
    rows = comments.select("comment_id", "input_hash").join(good, "input_hash")
    return rows.withColumn("id", analysis_id(model)).withColumn("model", F.lit(model))


def prompt_tokens(text: Column, template: str, schema: str) -> Column:
    """Estimated tokens of a prompt with the text set in as JSON, and of the answer's schema."""
    return S.token_estimate(F.concat(F.replace(F.lit(template), F.lit("{text}"), F.to_json(F.struct(text.alias("text")))), F.lit(schema)))


def cost_totals(items: DataFrame, key: Sequence[str], input_price: float | None, output_price: float | None) -> DataFrame:
    """Token sums, and their cost at prices for a million tokens; null unless both prices are given."""
    n = items.groupBy(*key).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = input_price is not None and output_price is not None
    return n.withColumn("cost", F.round((F.col("input_tokens") * F.lit(input_price) + F.col("output_tokens") * F.lit(output_price)) / 1_000_000, 6) if priced else F.lit(None).cast("double"))


def cost_range(usage: DataFrame, miss_price: float, hit_price: float, output_price: float) -> DataFrame:
    """Lowest and highest cost of ``usage`` (input_tokens, hit_tokens, miss_tokens, output_tokens): exact if hits and misses add up."""
    exact = F.col("hit_tokens") + F.col("miss_tokens") == F.col("input_tokens")
    million = lambda c: F.round(c / 1_000_000, 6)
    out = F.col("output_tokens") * output_price
    known = F.col("hit_tokens") * hit_price + F.col("miss_tokens") * miss_price
    low = F.when(exact, known).otherwise(F.col("input_tokens") * hit_price)
    high = F.when(exact, known).otherwise(F.col("input_tokens") * miss_price)
    return usage.withColumns({"min_cost": million(low + out), "max_cost": million(high + out)})


def latency_totals(requests: DataFrame, key: str, latency: str, tie: str) -> DataFrame:
    """Requests, mean and 95th percentile (the value at index int(0.95 n) - 1 of the sorted latencies)."""
    totals = requests.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("requests"), F.round(F.avg(latency), 4).alias("mean_latency"))
    ranked = numbered(requests.select(key, latency, tie), key, [F.col(latency), F.col(tie)], "_rank")
    at = F.greatest(F.lit(1), F.floor(F.col("requests") * 0.95))
    return ranked.join(totals, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("_rank") == at).select(key, "requests", "mean_latency", F.col(latency).alias("p95_latency"))


def job_report(items: DataFrame) -> DataFrame:
    """Counts of items by status."""
    states = ("pending", "processing", "completed", "failed", "skipped", "cancelled")
    return items.groupBy("job_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def advance(items: DataFrame, action: str, done: DataFrame | None = None) -> DataFrame:
    """New states of job items (job_id, comment_id, status): start, finish, resume, cancel or retry.

    ``finish`` takes ``done`` (job_id, comment_id, outcome) for processing items; ``resume`` puts processing items back; ``cancel``
    ends pending and processing items; ``retry`` gives the items of a new job with the failed ones.
    """
    status = F.col("status")
    if action == "start":
        return items.withColumn("status", F.when(status == "pending", "processing").otherwise(status))
    if action == "resume":
        return items.withColumn("status", F.when(status == "processing", "pending").otherwise(status))
    if action == "cancel":
        return items.withColumn("status", F.when(status.isin("pending", "processing"), "cancelled").otherwise(status))
    if action == "retry":
        return items.where(status == "failed").withColumns({"job_id": F.concat("job_id", F.lit(":retry")), "status": F.lit("pending")})
    if action == "finish" and done is not None:
        both = items.join(done, ["job_id", "comment_id"], "left")
        return both.withColumn("status", F.when((status == "processing") & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(status)).drop("outcome")
    raise ValueError(f"unknown action {action}")
