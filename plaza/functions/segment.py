"""Word segmentation of runs without spaces: a dictionary as a trie, the word graph over each run, and its best path by unigram probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs are thousandths of a natural logarithm, as whole numbers, so that sums and ties are the same everywhere.
SCALE = 1000
#: A dictionary travels with each job, so it is bounded; a larger one is refused.
MOST_WORDS = 2_000_000
_END = ""


class Dictionary:
    """Words with weights (counts). A custom word without a weight gets the sum of all others, so no path through its parts is better."""

    def __init__(self, weights: Iterable[tuple[str, int]], custom: Iterable[str | tuple[str, int]] = ()):
        known = {w: n for w, n in weights if w and n > 0}
        most = max(sum(known.values()), 1)
        for c in custom:
            word, n = (c, most) if isinstance(c, str) else c
            if word:
                known[word] = max(n, known.get(word, 0))
        if len(known) > MOST_WORDS:
            raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
        total = sum(known.values())
        self.trie: dict = {}
        for word, n in known.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[_END] = round(-SCALE * math.log(n / total))
        #: A character that is no word counts as a word of less than one occurrence.
        self.unknown = round(SCALE * math.log(max(total, 1))) + SCALE

    def cut(self, run: str) -> list[str]:
        """The pieces of the cheapest path; of equal ones that whose last pieces are longest."""
        n = len(run)
        cost, start = [0] + [-1] * n, [0] * (n + 1)
        for i in range(n):  # the word graph: all words from each place on
            node, j = self.trie.get(run[i]), i + 1
            edges = [] if node and _END in node else [(j, self.unknown)]
            while node is not None:
                if _END in node:
                    edges.append((j, node[_END]))
                node, j = node.get(run[j]) if j < n else None, j + 1
            for end, c in edges:
                if cost[end] < 0 or cost[i] + c < cost[end]:
                    cost[end], start[end] = cost[i] + c, i
        out, at = [], n
        while at:
            out.append(run[start[at] : at])
            at = start[at]
        return out[::-1]


def segmented(runs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(word, n) of ``runs`` (run, n), each distinct run cut once: how often each piece occurs."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pieces = [dictionary.cut(r) for r in frame["run"]]
            yield pd.DataFrame({"word": [w for p in pieces for w in p], "n": [n for p, n in zip(pieces, frame["n"], strict=True) for _ in p]}).groupby("word", as_index=False)["n"].sum()

    distinct = runs.where("run <> ''").groupBy("run").agg(F.sum("n").alias("n"))
    return distinct.mapInPandas(cut, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def learned(words: DataFrame, longest: int, least: int) -> Sequence[tuple[str, int]]:
    """A dictionary from a corpus: the words (word) of 2 to ``longest`` letters that occur ``least`` times or more. Raises where there are too many."""
    counts = words.where(F.length("word").between(2, longest)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    rows = counts.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} words")
    return [(r["word"], r["n"]) for r in rows]
