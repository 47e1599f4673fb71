"""Queries against their SQL on values that the given small tables lack."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plaza.operators import quality as Q


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The smallest tables with values above 487, and with texts of one letter and of generic words."""
    path = tmp_path_factory.mktemp("odd")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.withColumn("value", F.when(F.col("event_id") % 5 == 0, 900.0).otherwise(F.col("value"))).coalesce(1).write.parquet(str(path / "events.parquet"))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    short = F.element_at(F.array(*[F.lit(x) for x in ("Ee.", "A.", "Éé.", "Aaa aa.", "支持", "12 34.", "Ll l.")]), (F.col("doc_id") % 7 + 1).cast("int"))
    d.withColumn("text", F.when(F.col("doc_id") % 6 == 0, short).otherwise(F.col("text"))).coalesce(1).write.parquet(str(path / "documents.parquet"))
    spark.read.parquet(f"{sf}/embeddings.parquet").coalesce(1).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def same(spark, path, name):
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, path).toPandas()
    want = c.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else float(x)
    key = lambda df: sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False))
    return key(got) == key(want)


def test_domain_constraints_of_large_values(spark, odd):
    assert same(spark, odd, "e7_domain_constraints")
    rules = Q.with_issues(spark.createDataFrame([(1.5,), (0.5,)], "sentiment_score double").selectExpr("sentiment_score", "'neutral' sentiment", "'joy' emotion", "'support' stance", "'low' risk_level", "array('a') topics", "array('a') keywords", "array('a') risk_reasons"), Q.analysis_rules())
    assert [len(r.issues) for r in rules.collect()] == [1, 0]


@pytest.mark.parametrize("name", ["k14_review_table", "l1_stratified_sample", "k10_memberships"])
def test_rules_of_the_sql(spark, odd, name):
    assert same(spark, odd, name)
