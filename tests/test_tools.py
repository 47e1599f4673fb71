"""Scoped tools, tree hashes, files in parts, workbooks and streaming merges on small fixtures."""

import hashlib
import json
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaza.operators import opinion as O
from plaza.operators import semantic as M
from plaza.operators import tools as T
from plaza.sources import files as A
from plaza.sources.paths import fresh
from plaza.streaming import jobs as J


def test_requests_stay_in_scope(spark):
    scope = {"platform": "douyin", "content_id": 3}
    assert T.agreed(scope, {"platform": "douyin", "run_id": None}) == scope
    for request in ({"platform": "bilibili"}, {"run_id": "x"}, {"author_id": 1}):
        with pytest.raises(ValueError):
            T.agreed(scope, request)
    for bad in (0, 51):
        with pytest.raises(ValueError):
            T.some_comments(spark.range(1), {}, bad)
    with pytest.raises(ValueError):
        T.high_risk_comments(spark.range(1), spark.range(1), {}, 21)


def test_tree_hash_equals_a_plain_tree(spark):
    rows = [("a" if i % 3 else "b", f"id-{i}", f"v{i}") for i in range(100)] + [("a", "id-1", "v1")] * 2
    df = spark.createDataFrame(rows, "g string, k string, v string")
    got = {r.g: r.hash for r in O.tree_hash(df, "g", "k", "v").collect()}
    assert got == {r.g: r.hash for r in O.tree_hash(df.orderBy(F.rand(1)).repartition(3), "g", "k", "v").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def digest(lines):
        nodes = [(sha(x), n, f"{x}:{n}") for x, n in Counter(lines).items()]
        for size in (6, 3, 0):
            up = {}
            for name, n, child in nodes:
                up.setdefault(name[:size], []).append((n, child))
            nodes = [(name, n := sum(n for n, _ in x), f"{name}:{n}:" + sha("\n".join(sorted(c for _, c in x)))) for name, x in up.items()]
        return nodes[0][2].split(":")[-1]

    assert got == {g: digest([f"{k}:{v}" for h, k, v in rows if h == g]) for g in "ab"}


def test_json_array_in_parts(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f'x],["{i}') for i in range(50)], "a long, b string").repartition(3)
    path = fresh(spark, "parts")
    A.export_json_array(df, path)
    parts = sorted((r.path, bytes(r.content).decode()) for r in spark.read.format("binaryFile").load(path).collect())
    whole = json.loads("".join(x for _, x in parts))  # the files in their order are one array
    assert sorted(r["a"] for r in whole) == list(range(50)) and {r["a"]: r["b"] for r in whole}[3] is None
    assert sorted(map(tuple, A.read_json_parts(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    A.export_json_array(df.limit(0), none := fresh(spark, "parts"))
    assert A.read_json_parts(spark, none, df.schema).count() == 0 and json.loads(spark.read.text(none).first()[0]) == []


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(1, "s & t", 2, "<b>", None), (1, "s & t", 1, "a\x01b", "y"), (1, "u", 3, " lead", "z"), (2, "s & t", 4, "q", "")], "book int, sheet string, at int, a string, b string")
    A.export_workbooks(df, f"file://{tmp_path}", "book", "sheet", ["a", "b"], "at")
    assert zipfile.ZipFile(tmp_path / "1.xlsx").testzip() is None
    got = [(r.path[-6:], r.sheet, r.row, dict(r.record)) for r in A.read_xlsx(spark, f"file://{tmp_path}/*.xlsx").collect()]
    assert sorted(got, key=str) == sorted([("1.xlsx", "s & t", 2, {"a": "ab", "b": "y"}), ("1.xlsx", "s & t", 3, {"a": "<b>"}), ("1.xlsx", "u", 2, {"a": " lead", "b": "z"}), ("2.xlsx", "s & t", 2, {"a": "q"})], key=str)
    with pytest.raises(Exception, match="more than 2 rows"):
        A.export_workbooks(df, f"file://{tmp_path}", "book", "sheet", ["a"], "at", most_rows=2)


def test_run_id_follows_the_files(spark):
    prints = spark.createDataFrame([("a", "11"), ("b", "22")], "path string, sha256 string")
    assert A.run_id(prints).first() == A.run_id(prints.orderBy(F.desc("path"))).first() != A.run_id(prints.limit(1)).first()


def test_ingest_keeps_the_newest_version(spark):
    path, target, checkpoint = fresh(spark, "in"), fresh(spark, "table"), fresh(spark, "ckpt")
    for batch, newest in (([(1, 5, "new"), (2, 1, "a")], {1: "new", 2: "a"}), ([(1, 4, "late"), (2, 2, "b"), (3, 1, "c")], {1: "new", 2: "b", 3: "c"})):
        df = spark.createDataFrame(batch, "id long, rev long, v string")
        df.write.mode("append").parquet(path)
        J.ingest(J.landing_stream(spark, path, df.schema, "parquet"), target, ["id"], ["rev"], checkpoint, buckets=4, newest_wins=True).awaitTermination()
        assert {r.id: r.v for r in spark.read.parquet(target).collect()} == newest


def test_search_leaves_out_and_dedups(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[10] = v[11]
    items = spark.createDataFrame([(i, x.astype("float32").tolist(), f"t{11 if i == 10 else i}") for i, x in enumerate(v)], "item_id long, embedding array<float>, text string")
    queries = items.where("item_id < 7").select(F.col("item_id").alias("query_id"), "embedding")
    gone = items.where("item_id < 7").select("item_id")
    got = {}
    for r in M.search(items, queries, 4, most_queries=3, exclude=gone, dedup="text").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.item_id
    left = [i for i in range(7, 30) if i != 11]
    assert got == {q: dict(enumerate(sorted(left, key=lambda i: (-round(float(np.float32(v[i]).astype(float) @ np.float32(v[q]).astype(float)), 6), i))[:4], 1)) for q in range(7)}  # noqa: B023
    assert tuple(M.search_counts(items, gone, "text").first()) == (22, 8)
