"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure lies beyond a cutoff of its ladder, which goes from lax to strict. Cutoffs are chosen and certified per stratum
(the language column), from documents that pass the base rules:

1. The choice looks at the documents labelled bad and at those not labelled good, never at which good ones are beyond a cutoff. For each rule and
   rung it estimates how many good documents would go: the share of all documents beyond the cutoff, less what the bad ones explain. The rung with the best balance of caught bad and
   estimated loss is the rule's goal; a rule that separates nothing has none. Goals, the best first, give one path of joint
   verdicts: each rule is taken from its laxest rung to its goal, then the next is added; rungs that catch no further bad document are passed over.
2. Along this path every joint verdict is tested on all good documents: the exact binomial test at ``alpha`` divided by the strata rejects "it
   drops more than ``risk`` of the good documents". The first verdict that is not certified ends the path. As verdicts only grow and the path does not
   depend on the outcomes, this is fixed-sequence testing, and neither rules nor rungs cost a correction; strata are corrected for by Bonferroni.

A stratum whose good documents are too few for any certificate (``ln(alpha / strata) / ln(1 - risk)``) is not tested and takes no part in the correction; only numbers of documents decide that, not
outcomes. So with probability ``1 - alpha`` the learned rules together drop at most ``risk`` of the good documents of any stratum that pass the
base rules, which are not learned. Tests need independent trials, so of documents of a stratum and kind that share
their smallest shingle of five words, by which near copies mostly agree, one counts (the one with the smallest doc_id).

Cases: a null or empty text has no words and fails the base rules; repeated rows are judged alike, each for itself, and count once in
the tests; an empty table gives an empty result; labels that are null or whose document is missing are left out, and a document
that is labelled both ways counts as bad; columns other than the ones named are ignored; a null language is the stratum ``und``; very
long texts are measured whole, by one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.llm import textbytes as tb
from plaza.llm.shared import staged

#: Rule name -> (sign, cutoffs from lax to strict). With sign 1 values of at least the cutoff are rejected, with -1 values of at most it.
RULES: dict[str, tuple[int, tuple[float, ...]]] = {
    "symbol_ratio": (1, (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "dup_line_ratio": (1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeat_ratio": (1, (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "word_length_high": (1, (30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    "word_length_low": (-1, (1.0, 1.5, 2.0, 2.5, 3.0, 3.25, 3.5)),
}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
_MEASURES = "doc_id bigint, stratum string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, least bigint"


def text_measures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a whole text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    repeated = 0
    if len(count) < len(windows):
        end = 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated, len(lines)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [text_measures(t) for t in b.column(2).to_pylist()]
        columns = [pa.array(x, pa.int64()) for x in zip(*got, strict=True)] or [pa.array([], pa.int64())] * 6
        names = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "least"]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, pa.array(tb.least_shingles(b.column(2)))], names=names)


def measures(docs: DataFrame) -> DataFrame:
    """One row of measures for each row of ``docs`` (doc_id, text, lang); ``least`` is the smallest shingle hash."""
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("lang"), F.lit("und")).alias("stratum"), "text").mapInArrow(_measure, _MEASURES)


def _ratios() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": per_word("n_symbols"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": per_word("n_repeat_words"),
        "word_length_high": per_word("word_chars"),
        "word_length_low": per_word("word_chars"),
    }


def _level(value: Column, rule: str) -> Column:
    """The laxest rung whose cutoff rejects this value, counted from 1; one more than there are if none does.

    A value beyond a cutoff is beyond all stricter ones too, so the number of cutoffs it is beyond gives the rung.
    """
    sign, ladder = RULES[rule]
    return F.lit(len(ladder) + 1) - sum(((value >= c) if sign > 0 else (value <= c)).cast("int") for c in ladder)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, total)


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a rate, by bisection."""
    lo, hi = 0.0, 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and binomial_tail(k, n, mid) > level else (lo, mid) if mid > 0 else (mid, hi)
    return hi


def _base(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def holdout(measured: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """(stratum, kind, levels, n): how many documents that pass the base rules have each tuple of levels. ``kind`` is good, bad, or none for those without a label.

    Near copies are thinned. There are at most as many rows a stratum as the ladders have tuples of rungs.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.when(F.min("quality") > 0, "good").otherwise("bad").alias("kind"))
    passed = measured.where(~_base(min_words, max_repeat_percent)).drop("kind")
    held = passed.join(marked, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit("none")))
    ratios = _ratios()
    levels = F.struct(*[_level(ratios[r], r).alias(r) for r in RULES])
    thinned = held.groupBy("stratum", "kind", "least").agg(F.min_by(levels, F.struct("doc_id", "n_words")).alias("levels"))
    return thinned.groupBy("stratum", "kind", "levels").agg(F.count("*").alias("n"))


def choose_path(levels: dict[str, np.ndarray], n: np.ndarray, kind: np.ndarray, weight: float, risk: float) -> list[dict[str, int]]:
    """Joint verdicts, each the rung of every rule that is on, from the counts of one stratum. Of the good documents only their number is used."""
    n_good, n_bad, n_none = (int(n[kind == k].sum()) for k in ("good", "bad", "none"))
    if not n_good or not n_bad:
        return []
    bad, none, share = kind == "bad", kind == "none", n_bad / (n_good + n_bad)
    goals = []
    for k, (rule, (_, ladder)) in enumerate(RULES.items()):
        best, goal = 0.0, 0
        for rung in range(1, len(ladder) + 1):
            hit = levels[rule] <= rung
            caught, seen = n[hit & bad].sum() / n_bad, n[hit & none].sum() / max(1, n_none)
            lost = max(0.0, seen - share * caught) / (1 - share)
            gain = caught - weight * max(0.0, lost - risk / 2) / risk
            if gain > best:
                best, goal = gain, rung
        if goal:
            goals.append((-best, k, rule, goal))
    path, now, gone = [], {}, np.zeros(len(n), bool)
    for _, _, rule, goal in sorted(goals):
        for rung in range(1, goal + 1):
            hit = levels[rule] <= rung
            if n[hit & bad & ~gone].sum():
                now, gone = now | {rule: rung}, gone | hit
                path.append(now)
    return path


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.01, alpha: float = 0.05, weight: float = 0.5) -> DataFrame:
    """Certified cutoffs: (stratum, rule, rung, cutoff, n_good, n_lost, bound); rung 0 and a null cutoff for a rule that is off.

    ``cutoff`` is what ``judge`` applies. n_good, n_lost and bound are those of the certified joint verdict of the stratum.
    """
    held = staged(holdout(measured, labels), "holdout")
    good = held.where("kind = 'good'").groupBy("stratum").agg(F.sum("n").alias("n_good"))  # a row for each stratum with labels
    ranked = good.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_good"), "stratum")))
    strata = ranked.where(F.col("n_good") >= F.log(F.lit(alpha) / F.col("place")) / math.log1p(-risk)).agg(F.max("place")).first()[0] or 0
    tested = ranked.where(F.col("place") <= strata).select("stratum")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        levels, n, kind = {r: np.array([x[r] for x in pdf["levels"]]) for r in RULES}, pdf["n"].to_numpy(), pdf["kind"].to_numpy()
        n_good, n_lost, certified = int(n[kind == "good"].sum()), 0, {}
        for verdict in choose_path(levels, n, kind, weight, risk):
            hit = np.any([levels[r] <= rung for r, rung in verdict.items()], axis=0)
            lost = int(n[hit & (kind == "good")].sum())
            if binomial_tail(lost, n_good, risk) > alpha / strata:
                break
            n_lost, certified = lost, verdict
        bound = upper_bound(n_lost, n_good, alpha / strata)
        out = []
        for rule, (_, ladder) in RULES.items():
            rung = certified.get(rule, 0)
            out.append((pdf["stratum"].iloc[0], rule, rung, ladder[rung - 1] if rung else None, n_good, n_lost if rung else 0, bound if rung else None))
        return pd.DataFrame(out, columns=["stratum", "rule", "rung", "cutoff", "n_good", "n_lost", "bound"])

    return held.join(tested, "stratum").groupBy("stratum").applyInPandas(fit, "stratum string, rule string, rung int, cutoff double, n_good long, n_lost long, bound double")


def judge(measured: DataFrame, cutoffs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Adds base_failed, the list of broken rules, and kept to ``measured``."""
    limits = cutoffs.where("rung > 0").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "rung"))).alias("limits"))
    ratios = _ratios()
    broken = F.array_compact(F.array(*[F.when(_level(ratios[r], r) <= F.col("limits")[F.lit(r)], F.lit(r)) for r in RULES]))
    base = _base(min_words, max_repeat_percent)
    out = measured.join(limits, "stratum", "left").withColumn("base_failed", base).withColumn("broken_rules", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("limits")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    measured = staged(measures(docs), "measures")
    cutoffs = staged(fit_cutoffs(measured, spark.read.parquet(f"{sf_dir}/labels.parquet")), "cutoffs")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules"]
    return judge(measured, cutoffs).select(*names)


QUERIES = {"op1_quality_rules": op1_quality_rules}
