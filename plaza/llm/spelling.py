"""Spelling variants: words at one edit from each other, found by pivotal bigrams, and the form that each word is a variant of.

Bigrams are ordered by how many words have them. The prefix of a word holds its three rarest bigrams; one edit destroys two bigrams at most, so words
at one edit share one of these. Of its prefix a word chooses two disjoint pivots of the least total frequency, by dynamic programming over places; one
edit leaves one of them whole. Of two near words, that with the rarer prefix has its surviving pivot in the other's prefix, so pivots are looked up in
the index of prefixes.

Where the pivot stands limits what may differ. If the edit is behind the first pivot, all up to and with this pivot is equal, at the same place; else all from the
second pivot on is equal, at the same distance from the end. (So the first pivot is the first of its bigrams in the word, the second the last, and the
index needs no other places.) A posting holds the place and the equal side, and the other side is compared by its one-deletion forms: both
rests have one in common, or one rest is a one-deletion form of the other. This makes the comparison within a posting a join on equal keys in place of pairs within a
list: at most (letters x length) words have a key, so no key is hot. Keys are 64-bit hashes, made for all forms of a word from sums over it, in time linear in its length;
each pair is then verified by its edit distance.

A word's form is its near word with the most occurrences, if it has ten times as many. Forms lead to words with ever more occurrences, so
the way to the root has at most log10(most occurrences) steps, and doubling the steps reaches it.

Cases: a null or empty text has no words; a null doc_id is written as an empty string before the colon; repeated rows count each; ties between near words go to the
smallest; letters are single code points, and words of any length are compared whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import textbytes as TB
from plaza.llm.decontaminate import LOWER, UPPER
from plaza.llm.shared import staged

_GAP = "[^a-zÀ-ÿ]+"
_MARKED = "id bigint, word string, firsts array<int>, lasts array<int>, first array<int>, second array<int>"


def runs(docs: DataFrame, least: int = 7) -> DataFrame:
    """(doc_id, run) of all letter runs of ``docs`` (doc_id, text) of at least ``least`` code points, A to Z lower-cased."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.split(low, _GAP)).alias("run")).where(F.length("run") >= least)


def misspelled(found: DataFrame, every: int = 31) -> DataFrame:
    """(word) of runs (doc_id, run): one letter is left out of one run in ``every``, as the checksum of id and run has it."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % every == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of ``words`` (word)."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def bigram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and frequency of each bigram of ``words`` (word), the rarest first: at most the square of the alphabet, 8,100."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counted = sorted((r["n"], r["gram"]) for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect())
    return {gram: (rank, n) for rank, (n, gram) in enumerate(counted)}


def pivots(firsts: list[tuple[int, int]], lasts: list[tuple[int, int]], width: int = 2) -> tuple[int, int]:
    """A place of ``firsts`` and a later one of ``lasts``, each (place, cost) in the order of places, that do not overlap, of the least total cost."""
    best, cheapest, k = (math.inf, 0, 0), (math.inf, 0), 0
    for place, cost in lasts:
        while k < len(firsts) and firsts[k][0] + width <= place:  # the cheapest of all that end before this place
            cheapest, k = min(cheapest, firsts[k][::-1]), k + 1
        best = min(best, (cheapest[0] + cost, cheapest[1], place))
    return best[1], best[2]


def mark(word: str, ranks: dict[str, tuple[int, int]], edits: int = 1, width: int = 2) -> tuple[tuple[int, int], list[int], list[int]]:
    """Pivots of a word, and the first and last places of the bigrams of its prefix."""
    grams = sorted((*ranks[word[i : i + width]], i) for i in range(len(word) - width + 1))
    last, first_of, last_of = grams[min(width * edits, len(grams) - 1)][0], {}, {}
    for rank, cost, i in grams:
        if rank > last:
            break
        first_of.setdefault(rank, (i, cost))
        last_of[rank] = (i, cost)
    firsts, lasts = sorted(first_of.values()), sorted(last_of.values())
    return pivots(firsts, lasts, width), [i for i, _ in firsts], [i for i, _ in lasts]


def _mark_all(ranks: dict[str, tuple[int, int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [mark(w, ranks) for w in frame["word"]]
            yield pd.DataFrame({"id": frame["id"], "word": frame["word"], "firsts": [f for _, f, _ in found], "lasts": [x for *_, x in found], "first": [[p[0]] for p, *_ in found], "second": [[p[1]] for p, *_ in found]})

    return run


def form_keys(words: list[str], at: np.ndarray, side: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the entry and the key of each posting of the entries (word number ``at``, ``side``, ``place`` of the bigram).

    Side 0: all up to the bigram is equal, and the letters behind it are left out in turn. Side 1: all from the bigram on is equal.
    """
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(size) - size
    up, down = TB.powers(len(letters)), TB.powers(len(letters), pow(TB.BASE, -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[: len(letters)])])
    low, high = np.where(side == 0, place + 2, 0), np.where(side == 0, size[at], place)  # at ``high`` stands the word as it is
    n = high - low + 1
    entry = np.repeat(np.arange(len(at)), n)
    d = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + low[entry]
    s = begin[at][entry]
    whole, here = d == high[entry], np.minimum(s + d, len(letters) - 1)
    keep = whole | (d == low[entry]) | (letters[here] != letters[here - 1])  # of equal letters in a row the first stands for all
    entry, d, s, whole, here = entry[keep], d[keep], s[keep], whole[keep], here[keep]
    e = s + size[at][entry]
    of_all, of_rest = total[e] - total[s], (total[here] - total[s]) + (total[e] - total[here + 1]) * down[1]
    form = np.where(whole, of_all, of_rest) * down[s]
    where = np.where(side == 0, place, size[at] - place)[entry] * 2 + side[entry]
    length = size[at][entry] - ~whole
    return entry, TB.mix(TB.mix(form) + (where.astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64)).view(np.int64)


def _post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        size, lo = np.cumsum([len(w) for w in frame["word"]]), 0
        while lo < len(frame):  # some 100,000 letters at a time
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + 100_000, "right")))
            part = frame.iloc[lo:hi]
            n = [np.array([len(x) for x in part[c]], np.int64) for c in ("up", "on")]
            at = np.concatenate([np.repeat(np.arange(len(part)), k) for k in n])
            place = np.concatenate([np.asarray(x, np.int64) for c in ("up", "on") for x in part[c]])
            entry, key = form_keys(part["word"].tolist(), at, np.repeat([0, 1], [k.sum() for k in n]), place)
            yield pd.DataFrame({"key": key, "id": part["id"].to_numpy()[at[entry]]})
            lo = hi


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of ``words`` (id, word, n), distinct: both directions of all pairs at exactly one edit."""
    marked = staged(words.mapInPandas(_mark_all(bigram_ranks(words)), _MARKED), "marked")
    posted = lambda up, on: marked.select("id", "word", F.col(up).alias("up"), F.col(on).alias("on")).mapInPandas(_post, "key bigint, id bigint")
    pivot, prefix = posted("first", "second").toDF("key", "a"), posted("firsts", "lasts").toDF("key", "b")
    met = pivot.join(prefix, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = lambda c: words.select(F.col("id").alias(c), F.struct("word", "n").alias(f"of_{c}"))
    close = met.join(one("a"), "a").join(one("b"), "b").where(F.levenshtein("of_a.word", "of_b.word", 1) == 1)
    return close.select(F.explode(F.array(F.struct("of_a", "of_b"), F.struct(F.col("of_b").alias("of_a"), F.col("of_a").alias("of_b")))).alias("x")).select(F.col("x.of_a.word").alias("word"), F.col("x.of_b.word").alias("near"), F.col("x.of_b.n").alias("near_n"))


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word, n) and their ``pairs`` (word, near, near_n)."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").withColumn("found", -F.col("best.less") >= ratio * F.col("n"))
    return known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("found"), F.col("best.near")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, root) of the words of ``formed`` (word, n, form) that have a form, by doubling the steps until the longest possible way is done."""
    most = formed.agg(F.max("n")).first()[0] or 1
    steps, ways = max(1, int(math.log(most, ratio)) + 1), formed.where("form is not null").select("word", F.col("form").alias("root"))
    done = 1
    while done < steps:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        ways = staged(ways.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "ways")
        done *= 2
    return ways


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vocabulary(misspelled(runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    words = staged(found.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    formed = staged(forms(words, near_pairs(words)), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP13_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
-- The checksum bit by bit: each byte is followed by eight shifts, written as -1.
summed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(0, len(x) // 2), lambda i: list_prepend(CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
                   lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS h FROM each),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed) t
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
del AS (SELECT word, n, d, word[:d - 1] || word[d + 1:] AS form FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS d FROM w) t),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.form = b.form AND a.d = b.d AND a.word <> b.word
          UNION SELECT del.word, w.word, w.n FROM del JOIN w ON del.form = w.word UNION SELECT w.word, del.word, del.n FROM del JOIN w ON del.form = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM formed UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON way.root = formed.word WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN way ON way.word = f.word JOIN formed e ON e.word = way.root AND e.form IS NULL
"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {"op13_spelling": OP13_SQL}
