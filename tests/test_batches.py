"""Python functions over Arrow batches hold a slice of a batch as objects."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from plaza.functions import scalar as S
from plaza.functions.batches import slices
from plaza.operators import labeling as L
from plaza.sources import pages as P


def test_slices_are_whole_and_bounded():
    b = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * (50_000 if i == 700 else 10) for i in range(1000)]})
    parts = list(slices(b, 256, 20_000))
    assert pa.Table.from_batches(parts).to_pydict() == b.to_pydict()
    assert all(p.num_rows <= 256 and (p.nbytes <= 20_000 or p.num_rows == 1) for p in parts)


def test_pages_are_freed_as_they_are_read():
    html = '<div class="l_post" data-field="{}">' + "<p>word <b>bold</b></p>" * 300 + "</div>"
    b = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([html] * 400), pa.array([None] * 400, pa.string())], names=["page_id", "html", "parent_id"])
    tracemalloc.start()
    list(P._extract(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6


def test_labeler_gets_some_hundred_texts_at_a_time(spark):
    def labeler(texts):
        assert len(texts) <= 256
        return [None if t == "7" else t for t in texts]

    got = L.apply_labeler(spark.range(2000).coalesce(1).select("id", F.col("id").cast("string").alias("text")), labeler).collect()
    assert {(r.id, r.output, r.failure) for r in got} == {(i, None if i == 7 else str(i), "no output" if i == 7 else None) for i in range(2000)}


def test_information_score_of_long_text(spark):
    text = "the quick brown fox é 支持 😀😀 " * 4
    chars = [c for c in text if not c.isspace()]
    good = sum(c.isascii() and c.isalnum() or c in "支持" for c in chars)
    most = max(chars.count(c) for c in set(chars))
    want = (0.55 * min(good, 80) / 80 + 0.45 * good / len(chars)) * (1 - max(0.0, (most / len(chars) - 0.35) / 0.65))
    df = spark.createDataFrame([(text,), ("aaaaaaa",), ("",), (None,)], "x string")
    got = [r[0] for r in df.select(S.information_score(F.col("x"))).collect()]
    assert abs(got[0] - want) < 1e-12 and got[2:] == [0.0, 0.0]
    assert got[1] == 0.0
    plan = df.select(S.information_score(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # and not in the loop over characters
