"""Aggregates, trends and inflections on a small set of comments about a park, with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plaza.operators import opinion as O

COLUMNS = "id long, comment_id long, created_at timestamp, sentiment string, sentiment_score double, emotion string, stance string, risk_level string, topics array<string>, keywords array<string>, risk_reasons array<string>"
ANALYSES = {
    0: ("negative", -0.5, "sadness", "oppose", "medium", ["parking"], ["full"], ["crowding"]),
    1: ("negative", -0.9, "anger", "oppose", "high", ["parking", "fees"], ["ticket", "full"], ["fine"]),
    2: ("neutral", 0.1, "neutral", "unclear", "low", ["opening hours"], ["sunday"], []),
    3: ("positive", 0.6, "joy", "support", "low", ["staff"], ["friendly"], []),
    4: ("positive", 0.7, "joy", "support", "low", ["staff", "fees"], ["friendly", "cheap"], []),
    5: ("negative", -0.4, "sadness", "neutral", "low", ["fees"], ["ticket"], []),
    6: ("neutral", 0.0, "neutral", "neutral", "low", ["opening hours"], ["sunday"], []),
    7: ("negative", -0.8, "anger", "oppose", "high", ["parking"], ["full"], ["crowding", "fine"]),
    8: ("positive", 0.9, "surprise", "support", "low", ["garden"], ["roses"], []),
    9: ("positive", 0.5, "joy", "neutral", "medium", ["garden"], ["roses"], ["allergy"]),
    10: ("negative", -0.6, "anger", "oppose", "high", ["fees"], ["ticket"], ["fine"]),
}


@pytest.fixture(scope="module")
def sets(spark):
    """Twelve comments on the 1st, 2nd, 3rd and 5th of May, eleven of them analyzed, one of those twice."""
    days = [1, 1, 1, 2, 2, 2, 2, 2, 3, 3, 5, 5]
    rows = [(i, "park", "bilibili", "spring", dt.datetime(2024, 5, d, 9 + i), 0, i * 5 % 7) for i, d in enumerate(days)]
    comments = spark.createDataFrame(rows, "comment_id long, content_id string, platform string, run_id string, published_at timestamp, depth int, like_count long")
    newest = [(50 + i, i, dt.datetime(2024, 6, 1), *x) for i, x in ANALYSES.items()]
    older = [(40, 3, dt.datetime(2024, 5, 20), "negative", -1.0, "anger", "oppose", "high", ["weather"], [], [])]
    return comments, spark.createDataFrame(newest + older, COLUMNS)


def test_distribution_and_scores(sets):
    newest = O.latest(sets[1], sets[0])
    got = {(r.dimension, r.value): (r["count"], r.percentage) for r in O.distribution(newest).collect()}
    assert [got["sentiment", x] for x in ("negative", "positive", "neutral")] == [(5, 45.45), (4, 36.36), (2, 18.18)]
    assert got["risk_level", "high"] == (3, 27.27) and got["stance", "unclear"] == (1, 9.09)
    assert O.score_statistics(newest).first().mean_score == -0.0364


def test_frequencies(sets):
    newest = O.latest(sets[1], sets[0])
    topics = [(r.value, r["count"]) for r in O.frequency(newest, "topics").collect()]
    assert topics == [("fees", 4), ("parking", 3), ("garden", 2), ("opening hours", 2), ("staff", 2)]
    assert [(r.value, r["count"]) for r in O.frequency(newest, "risk_reasons").collect()] == [("fine", 3), ("crowding", 2), ("allergy", 1)]
    assert [r.comments for r in O.volume_by_date(sets[0]).orderBy("day").collect()] == [3, 5, 2, 2]


def test_coverage_and_latest(sets):
    assert tuple(O.coverage(*sets).first()) == (12, 11)
    assert O.latest(sets[1], sets[0]).where("comment_id = 3").first().id == 53


def _points(spark, rows):
    names = ["total_comments", "analyzed_comments", "negative_count", "medium_risk_count", "high_risk_count"]
    full = [(dt.datetime(2024, 5, d), *x) for d, *x in rows]
    df = spark.createDataFrame(full, "bucket_start timestamp, " + ", ".join(f"{n} long" for n in names))
    return O.trend_measures(df)


def test_trend_measures_and_inflections(spark):
    p = _points(spark, [(3, 20, 16, 4, 2, 1), (4, 40, 25, 15, 5, 5), (5, 12, 10, 1, 0, 0)])
    assert [r.risk_score for r in p.orderBy("bucket_start").collect()] == [16.56, 40.0, 5.0]
    s = O.trend_summary(p).first()
    assert (s.overall_risk_score, s.peak_risk_at.day, s.data_quality, s.analysis_coverage) == (25.78, 4, "partial", 0.7083)
    assert [(r.kind, r.severity, r.score_delta) for r in O.inflections(p, "day", 5).collect()] == [("risk_spike", "medium", 23.44), ("recovery", "high", -35.0)]
    assert O.inflections(p, "day", 5, most=1).first().kind == "recovery"


def test_gap_and_quality(spark):
    apart = _points(spark, [(10, 12, 12, 0, 0, 0), (13, 36, 36, 36, 0, 36)])
    assert O.inflections(apart, "day", 5).count() == 0  # the days between have no bucket
    full = O.trend_summary(_points(spark, [(7, 8, 7, 0, 0, 0)])).first()
    assert (full.data_quality, full.analysis_coverage) == ("sufficient", 0.875)
    none = O.trend_summary(_points(spark, [(7, 6, 0, 0, 0, 0)])).first()
    assert none.data_quality == "no_analyses" and none.peak_risk_at is None
    assert O.trend_summary(_points(spark, [])).first().data_quality == "no_data"


def test_scope_and_pages(sets):
    with pytest.raises(ValueError):
        O.between(sets[0], "2024-05-03", "2024-05-03")
    with pytest.raises(ValueError):
        O.page(sets[0], [F.col("comment_id")], limit=0)
    assert O.between(sets[0], "2024-05-02", "2024-05-03").count() == 5
    assert [r.comment_id for r in O.comments_page(sets[0], limit=3, offset=2).collect()] == [2, 3, 4]


def test_high_risk_and_summary(sets):
    assert [r.comment_id for r in O.high_risk(*sets).collect()] == [1, 10, 7]
    rows = {(r.section, r.key): r.n for r in O.opinion_summary(*sets).where("subkey is null").collect()}
    assert rows["coverage", "partial"] == 11 and rows["score", "mean"] == -0.0364 and rows["topics", "fees"] == 4


def test_trend_reads_only_analyses_of_the_given_comments(sets):
    day = sets[0].where("comment_id < 3")
    (r,) = O.trend(day, sets[1], "day").collect()
    assert (r.total_comments, r.analyzed_comments, r.negative_count, r.high_risk_count, r.mean_sentiment_score) == (3, 3, 2, 1, -0.4333)
    assert [x.comment_id for x in O.high_risk(day, sets[1]).collect()] == [1]
