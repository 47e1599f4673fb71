"""The corpus pipeline: five operators in a row, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again. All but the
last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaza.llm import decontaminate, lsh_forest, mixing, token_files, toxicity
from plaza.llm.shared import staged


def _held(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one, so that none clashes with the names that a stage uses."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("held"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model learns from the labelled documents outside the hold-out."""
    held = toxicity.with_held_out(docs.select("doc_id", "text"), 5, 0)
    model = toxicity.fit(held.where("not held_out").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Rows that repeat a doc_id with different texts are documents of their own; of rows that repeat both, the one with the smallest
    hash of all columns stays. Rows without a doc_id stay.
    """
    classes = lsh_forest.near_duplicates(docs.select("doc_id", "text"))
    gone = classes.where("not is_first").select("doc_id", "text_key").distinct()
    keyed = _held(docs).select("held", F.col("held.doc_id").cast("bigint").alias("doc_id"), F.xxhash64("held.text").alias("text_key"))
    kept = keyed.join(gone, ["doc_id", "text_key"], "left_anti")
    if classes.where("doc_id is not null").groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept.select("held.*")
    alike = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("held"))
    first = kept.where("doc_id is not null").withColumn("rank", F.row_number().over(alike)).where("rank = 1")
    return first.select("held.*").union(kept.where("doc_id is null").select("held.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has it; with the default budget each at least once."""
    counted = staged(mixing.with_tokens(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens"), "counted")
    copies = mixing.mix(counted).where("copies > 0").select("doc_id", "source", "copies").distinct()
    same = F.col("held.doc_id").eqNullSafe(F.col("doc_id")) & F.col("held.source").eqNullSafe(F.col("source"))
    return _held(docs).join(copies, same).select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("held.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their digest."""
    return token_files.token_table(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: A learned model is the first stage, which SQL cannot express; tests compare the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
