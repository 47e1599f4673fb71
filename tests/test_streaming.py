"""Merge logs, live trends and alerts, trailing rates, digests, and search by tiles."""

import os
import random
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaza.functions.digest import set_digest
from plaza.operators import opinion as O
from plaza.operators import semantic as M
from plaza.operators.merge_log import LogTable
from plaza.streaming import jobs as J

ROWS = T.StructType().add("k", "long").add("v", "long").add("t", "string")
DAY = datetime(2024, 5, 1)


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def log_table(spark, tmp_path, **options):
    return LogTable(spark, f"t_{uuid.uuid4().hex}", f"{tmp_path}/t", ROWS, ["k"], ["v", "t"], **options)


def rows(table, before=None):
    return {tuple(r) for r in table.read(before).collect()}


def test_merge_log_keeps_the_newest_row_and_writes_the_batch_only(spark, tmp_path):
    table = log_table(spark, tmp_path, buckets=4)
    table.append(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("t")), 0)
    assert table.compact(1) and not table.compact(1)
    stored = size(f"{tmp_path}/t")
    small = spark.createDataFrame([(5, 2, "new"), (5, 3, "newer"), (7, 0, "old"), (30_000, 1, None)], ROWS)
    table.append(small, 1)
    assert size(f"{tmp_path}/t") - stored < stored / 100
    got = {r[0]: r[1:] for r in rows(table)}
    assert len(got) == 20_001 and got[5] == (3, "newer") and got[7][0] == 1 and got[30_000] == (1, None)
    assert len(rows(table, 1)) == 20_000
    table.append(small, 1)  # the batch again
    assert {r[0]: r[1:] for r in rows(table)} == got and not table.compact(2)
    assert table.compact(2, ratio=0) and {r[0]: r[1:] for r in rows(table)} == got
    assert os.listdir(f"{tmp_path}/t/base") == ["base=2"]


def test_merge_log_does_not_shuffle_the_base(spark, tmp_path):
    table = log_table(spark, tmp_path, buckets=8)
    table.append(spark.range(1000).selectExpr("id as k", "id as v", "'x' as t"), 0)
    table.compact(1)
    table.append(spark.createDataFrame([(1, 5000, "y")], ROWS), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = table.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    base = plan[plan.index("FileScan parquet spark_catalog") - 600 : plan.index("FileScan parquet spark_catalog")]
    assert "Exchange" not in base.split("SortMergeJoin")[-1].split(":-")[-1] and "Bucketed: true" in plan


def test_merge_log_of_a_new_session_and_empty(spark, tmp_path):
    table = log_table(spark, tmp_path)
    assert rows(table) == set() and not table.compact(0)
    table.append(spark.createDataFrame([(1, 1, "a"), (None, 1, "b")], ROWS), 0)
    table.compact(1)
    spark.sql(f"DROP TABLE {table.name}_1")
    assert {r for r in rows(table) if r[0]} == {(1, 1, "a")}


def facts(spark, comments=(), labels=()):
    c = [(k, at, None, None, None, None, None) for k, at in comments]
    return spark.createDataFrame(c + [(k, None, i, DAY + timedelta(days=i), s, r, x) for k, i, s, r, x in labels], J.FACTS)


def test_late_labels_add_change_and_retract_alerts(spark, tmp_path):
    live = J.LiveTrend(spark, f"l_{uuid.uuid4().hex}", str(tmp_path), "hour", 2, buckets=2)
    at = lambda h: DAY + timedelta(hours=h)
    standing = lambda: {(r.bucket_start, r.kind) for r in live.alerts.read().where("active").collect()}
    live.update(facts(spark, [(k, at(k // 4)) for k in range(12)], [(k, 1, "neutral", "low", 0.0) for k in range(12)]), 0)
    assert standing() == set()
    live.update(facts(spark, labels=[(k, 2, "negative", "high", -1.0) for k in range(4, 8)]), 1)
    assert standing() == {(at(1), "risk_spike"), (at(2), "recovery")}
    live.update(facts(spark, labels=[(k, 3, "neutral", "low", 0.5) for k in range(4, 8)]), 2)
    assert standing() == set() and live.alerts.read().where("not active").count() == 2
    late = facts(spark, labels=[(k, 2, "negative", "high", -1.0) for k in range(4, 8)])  # older than what is known
    live.update(late, 3)
    live.update(late, 3)
    assert standing() == set()


def test_live_trend_equals_the_batch_trend_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    comments = [(k, DAY + timedelta(minutes=rng.randrange(3000)) if k % 9 else None) for k in range(80)]
    labels = [(rng.randrange(90), i, rng.choice(["positive", "negative", "neutral", None]), rng.choice(["low", "high", "medium"]), rng.choice([None, 0.25, -0.7])) for i in range(150)]
    c = spark.createDataFrame(comments, "comment_id bigint, published_at timestamp")
    a = spark.createDataFrame([(k, i, DAY + timedelta(days=i), s, r, x) for k, i, s, r, x in labels], "comment_id bigint, id bigint, created_at timestamp, sentiment string, risk_level string, sentiment_score double")
    want = {tuple(r) for r in O.trend(c, a, "day").collect()}
    live = J.LiveTrend(spark, f"l_{uuid.uuid4().hex}", str(tmp_path), "day", 2, buckets=2)
    mixed = [("c", x) for x in comments if x[1]] + [("l", x) for x in labels]
    rng.shuffle(mixed)
    for n in range(3):
        part = mixed[n::3]
        live.update(facts(spark, [x for k, x in part if k == "c"], [x for k, x in part if k == "l"]), n)
    assert {tuple(r) for r in live.buckets().collect()} == want


@pytest.mark.parametrize("slot", [60, 61, 3600])
def test_trailing_rate_equals_a_plain_count(spark, slot):
    rng = random.Random(slot)
    data = [(i, rng.choice("aab"), DAY + timedelta(microseconds=rng.choice([0, 1, 60_000_000, 59_999_999, 3_600_000_000, rng.randrange(4_000_000_000)]))) for i in range(120)]
    df = spark.createDataFrame([*data, (999, "a", None)], "id bigint, k string, at timestamp")
    got = {r.id: r.requests for r in J.trailing_rate(df, ["k"], "at", 60, slot).collect()}
    assert got == {i: sum(1 for _, k2, t2 in data if k2 == k and timedelta(0) <= t - t2 < timedelta(seconds=60)) for i, k, t in data} | {999: None}


def test_digest_knows_the_set_and_nothing_else(spark):
    ids = [str(uuid.uuid4()) for _ in range(300)] + ["1234567890123456789", "", None]
    make = lambda x: spark.createDataFrame([("g", i) for i in x] + [("h", "a")], "g string, id string")
    digest = lambda x: {r.g: (r.n, r.hash) for r in set_digest(make(x), ["g"], F.col("id")).collect()}
    one = digest(ids)
    assert digest(random.Random(1).sample(ids, len(ids))) == one and one["g"][0] == 303
    assert digest(ids[1:])["g"] != one["g"] and digest(ids + ids[:1])["g"] != one["g"] and digest(ids[1:])["h"] == one["h"]
    assert digest(ids, )["g"] != digest([*ids[:-1], "x"])["g"]
    assert set_digest(make([]).where("false"), ["g"], F.col("id")).count() == 0


def test_search_by_tiles_equals_search(spark):
    v = np.round(np.random.default_rng(0).normal(size=(90, 5)), 1)
    v[40:50] = v[0]
    df = spark.createDataFrame([(i, x.tolist(), i % 7) for i, x in enumerate(v)], "id bigint, embedding array<double>, g int")
    items, queries = df.select(F.col("id").alias("item_id"), "embedding", "g"), df.select(F.col("id").alias("query_id"), "embedding")
    out = F.struct("query_id", "item_id", "similarity", "rank")
    for options in ({}, {"least": 0.5}, {"exclude": items.where("item_id < 5").select("item_id")}, {"dedup": "g"}):
        assert {r[0] for r in M.search_many(items, queries, 4, block=13, **options).select(out).collect()} == {r[0] for r in M.search(items, queries, 4, **options).select(out).collect()}
    assert M.search_many(items.where("false"), queries, 4).count() == 0
