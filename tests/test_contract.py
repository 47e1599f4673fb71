"""The driver contract, and queries against their SQL on the smallest data."""

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    for path in (ROOT / "plaza").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"plaza\.llm|from plaza import .*llm", path.read_text(encoding="utf-8")), path


def test_sample_of_queries_against_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "documents", "customer", "orders", "lineitem", "embeddings", "labels", "conversations", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("h10_trend_day", "h5_distribution", "i1_latest_analysis", "j5_semi_anti", "e5_row_routing", "f1_entity_upsert"):
        got, want = queries[name](spark, sf).toPandas(), c.execute(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), name
