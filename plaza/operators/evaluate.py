"""How good labels are: coverage and rule violations, agreement on equal texts, and scores against gold labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_quality(sample: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row over ``sample`` (comment_id, quality_eligible) and ``analyses`` (comment_id and labels): counts, success rate, violations.

    Violations: a positive label with a negative score or the reverse, high risk without a reason, a summary out of 1 to 200 characters.
    """
    x = sample.select("comment_id", "quality_eligible").join(analyses.withColumn("_known", F.lit(True)), "comment_id", "left")
    out = x.agg(
        F.count("*").alias("sample"), F.count("_known").alias("analyzed"), F.count_if(F.col("_known").isNull()).alias("missing"), F.count_if("quality_eligible").alias("eligible"),
        F.count_if((F.col("sentiment") == "positive") & (F.col("sentiment_score") < 0)).alias("positive_below_zero"), F.count_if((F.col("sentiment") == "negative") & (F.col("sentiment_score") > 0)).alias("negative_above_zero"),
        F.count_if((F.col("risk_level") == "high") & (F.size("risk_reasons") == 0)).alias("high_without_reason"), F.count_if(F.col("_known") & (F.size("topics") > 10)).alias("too_many_topics"),
    )
    return out.withColumn("success_rate", F.when(F.col("sample") > 0, F.round(F.col("analyzed") / F.col("sample"), 4)).otherwise(0.0))


def duplicate_consistency(analyses: DataFrame, text_hash: str, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, groups, consistent, rate) over groups of at least two analyses of equal text, for each dimension and for all jointly."""
    columns = {d: F.col(d) for d in dimensions} | {"joint": F.struct(*dimensions)}
    g = analyses.groupBy(text_hash).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{d}") for d, c in columns.items()]).where("n >= 2")
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), (F.col(f"d_{d}") == 1).alias("same")) for d in columns]))
    out = g.select(rows.alias("x")).groupBy("x.dimension").agg(F.count("*").alias("groups"), F.count_if("x.same").alias("consistent"))
    return out.withColumn("rate", F.round(F.col("consistent") / F.col("groups"), 4))


def confusion(pairs: DataFrame) -> DataFrame:
    """(dimension, gold, predicted, n) of ``pairs`` (dimension, gold, predicted); rows without a gold label do not count."""
    return pairs.where("gold is not null and predicted is not null").groupBy("dimension", "gold", "predicted").agg(F.count("*").alias("n"))


def label_scores(matrix: DataFrame) -> DataFrame:
    """(dimension, label, precision, recall, f1), for labels seen on either side."""
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("gold").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("predicted").alias("side"))))
    x = matrix.select("dimension", "n", (F.col("gold") == F.col("predicted")).alias("right"), sides.alias("s"))
    total = lambda side: F.coalesce(F.sum(F.when(F.col("s.side") == side, F.col("n"))), F.lit(0))
    y = x.groupBy("dimension", F.col("s.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("right") & (F.col("s.side") == "gold"), F.col("n"))), F.lit(0)).alias("tp"), total("gold").alias("gold"), total("predicted").alias("predicted")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return y.select(
        "dimension", "label", F.round(ratio(F.col("tp"), F.col("predicted")), 4).alias("precision"), F.round(ratio(F.col("tp"), F.col("gold")), 4).alias("recall"),
        F.round(ratio(2 * F.col("tp"), F.col("gold") + F.col("predicted")), 4).alias("f1"),
    )


def supervised(pairs: DataFrame) -> DataFrame:
    """(dimension, labeled, accuracy, macro_f1)."""
    m = confusion(pairs)
    a = m.groupBy("dimension").agg(F.sum("n").alias("labeled"), F.round(F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("accuracy"))
    return a.join(label_scores(m).groupBy("dimension").agg(F.round(F.avg("f1"), 4).alias("macro_f1")), "dimension")
