"""A relational store that runs inside the session's JVM, and workbooks by the name of the store."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plaza.sources import files as A
from plaza.sources import stores as D


@pytest.fixture
def url(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_round_trip_in_parts_with_pushed_filters(spark, sf, url):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
    A.save(e, "db", "EVENTS", {"url": url})
    back = D.read_table(spark, url, "EVENTS", "event_id", rows_per_part=200)
    assert back.rdd.getNumPartitions() == -(-e.count() // 200)
    assert back.exceptAll(e).isEmpty() and e.exceptAll(back).isEmpty()
    some = back.where((F.col("user_id") == 3) & (F.col("event_id") > 50)).select("event_id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*EqualTo(user_id,3)" in plan and "*GreaterThan(event_id,50)" in plan and "event_type" not in plan.split("ReadSchema")[1]
    assert some.count() == e.where("user_id = 3 and event_id > 50").count()


def test_upsert_through_a_staging_table(spark, url):
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, name string, n int")
    A.save(rows((1, "a", 1), (2, "b", 2)), "postgres", "T", {"url": url})
    for _ in range(2):  # again changes nothing
        A.save(rows((2, "B", None), (3, "c", 3)), "db", "T", {"url": url, "key": "id"})
    read = lambda: {tuple(r) for r in D.read_table(spark, url, "T", "id").collect()}
    assert read() == {(1, "a", 1), (2, "B", None), (3, "c", 3)}
    D.upsert_table(rows((1, None, 5), (2, "z", None)), url, "T", ["id"], keep_if_null=True)
    assert read() == {(1, "a", 5), (2, "z", None), (3, "c", 3)}
    tables = spark.read.jdbc(url, "SYS.SYSTABLES").where("TABLENAME LIKE 'STAGE%'")
    assert tables.count() == 0
    with pytest.raises(Exception):
        D.upsert_table(rows((4, "x" * 10, 1)).withColumn("other", F.lit(1)), url, "T", ["id"])
    assert tables.count() == 0 and len(read()) == 3


def test_empty_and_equal_keys(spark, url):
    t = spark.createDataFrame([(datetime(2024, 1, 1), "x")] * 3, "at timestamp, v string")
    A.save(t.limit(0), "db", "E", {"url": url})
    assert D.read_table(spark, url, "E", "at", 1).count() == 0
    A.save(t, "db", "E", {"url": url})
    assert D.read_table(spark, url, "E", "at", 1).count() == 3


def test_excel_by_name(spark, tmp_path):
    df = spark.createDataFrame([("b1", "s1", 1, "x"), ("b1", "s2", 2, None), ("b2", "s1", 3, "y")], "book string, sheet string, k int, v string")
    A.save(df, "excel", f"{tmp_path}/out", {"book": "book", "sheet": "sheet", "order": "k"})
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["b1.xlsx", "b2.xlsx"]
    with pytest.raises(ValueError):
        A.save(df, "mongodb", "t")
