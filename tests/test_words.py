"""Segmentation against all paths, and word counts with custom words."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plaza.functions import segment as G
from plaza.operators import opinion as O


def all_paths(run):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        yield [run[i:j] for i, j in zip(at, at[1:], strict=False)]


def test_cut_is_the_cheapest_of_all_paths():
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choices("天地人山", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        d, total = G.Dictionary(words.items()), sum(words.values())
        cost = lambda p: sum(round(-1000 * math.log(words[w] / total)) if w in words else d.unknown if len(w) == 1 else math.inf for w in p)  # noqa: B023, E731
        run = "".join(rng.choices("天地人山火", k=9))
        assert cost(d.cut(run)) == min(cost(p) for p in all_paths(run))


def test_custom_words_win_over_their_parts():
    weights = [("北京", 90), ("大学", 80), ("生", 5), ("大学生", 10), ("京大", 1)]
    assert G.Dictionary(weights).cut("北京大学生") == ["北京", "大学生"]
    assert G.Dictionary(weights, ["北京大学"]).cut("北京大学生") == ["北京大学", "生"]
    assert G.Dictionary(weights, [("北京大学", 1)]).cut("北京大学") == ["北京", "大学"]
    assert G.Dictionary([]).cut("北京") == ["北", "京"] and G.Dictionary([]).cut("") == []


def test_word_frequency_counts_each_occurrence_once(spark):
    df = spark.createDataFrame([("北京大学生 love Spark 北京", "x"), (None, "y"), ("", "z"), ("北京大学, C++ c++ rocks", "x")], "text string, word string")
    count = lambda **o: {r["word"]: r["count"] for r in O.word_frequency(F.col("text"), df, **o).collect()}
    dictionary = [("北京", 90), ("大学", 80), ("大学生", 10), ("生", 5)]
    assert count(dictionary=dictionary) == {"北京": 3, "大学生": 1, "大学": 1, "love": 1, "spark": 1, "c": 2, "rocks": 1}
    assert count(dictionary=dictionary, custom=["北京大学", "C++"]) == {"北京大学": 2, "生": 1, "北京": 1, "love": 1, "spark": 1, "c++": 2, "rocks": 1}
    assert count(custom=["北京大学"], stop_words=["love"]) == {"北京大学": 2, "生": 1, "北京": 1, "spark": 1, "c": 2, "rocks": 1}


def test_segmented_adds_up_runs(spark):
    runs = spark.createDataFrame([("aab", 2), ("aab", 3), ("", 9), ("b", 1)], "run string, n bigint")
    assert {(r.word, r.n) for r in G.segmented(runs, G.Dictionary([("aa", 5)])).collect()} == {("aa", 5), ("b", 6)}


def test_a_dictionary_is_bounded(monkeypatch):
    monkeypatch.setattr(G, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        G.Dictionary([("a", 1), ("b", 1), ("c", 1)])
