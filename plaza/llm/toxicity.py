"""Toxicity: a learned lexicon in a trie, matched by Levenshtein automata, weighed by context windows.

1. Lexicon. Over a bounded sample of labelled documents (about ``sample`` of them, by a hash of doc_id; near copies are
   thinned to one by their smallest shingle hash) Spark counts in how many toxic and other documents each word and each
   word beginning occurs (words of two letters or more; beginnings of 3 to 10 letters). All entries whose share of toxic
   documents cannot be chance are kept; a beginning is prolonged while it keeps nine tenths of its toxic documents, and becomes a
   whole word if one word accounts for them.
2. Matching. The Levenshtein automata of all entries are intersected with the trie of the lexicon, and the product is
   determinised on demand, one state for each set of (trie node, edits). Longer entries allow more edits (0, 1 or 2);
   swapped neighbours count as one edit. Most words reach the dead state after a few letters.
3. Context. In a window around each match, quotation marks around it or a reporting word before it make it a
   quotation; otherwise it is plain. Each (entry, exact or misspelled, plain or quoted) has a weight: its smoothed log
   odds among the sampled documents. A document's score is the logistic function of the prior plus the weights of its matches.

Cases: a null or empty text has no match and scores the prior, below one half; repeated rows score alike; without labels,
or without toxic ones, the lexicon is empty and all scores are low; labels that are null, or repeated for a document with
different values, count as toxic if any says so; a null doc_id is not held out and not learned from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import textbytes as tb
from plaza.llm.language_id import with_held_out
from plaza.llm.shared import staged

TOKEN = re.compile(r"\w(?:[\w@$*!]*\w)?")
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say quoted quote quotes called calls wrote writes word words term terms slur insult insults dit disait mot mots écrit sagte sagt wort wörter schrieb dijo dice palabra palabras escribió".split())
LEAST_WORD, SHORTEST, LONGEST = 2, 3, 10  # letters of a word, of the shortest and of the longest beginning that are learned
_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
Lexicon = dict[str, bool]  # entry -> whether it stands for all words that begin with it


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word (after ``=``) and each word beginning (after ``^``), by label, summed over the task's rows."""
    count: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        names = list(count[0].keys() | count[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())], names=["entry", "toxic", "other"])
        count[0].clear()
        count[1].clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {t for t in tokens(text) if len(t) >= LEAST_WORD}
            count[toxic].update("=" + t for t in found)
            count[toxic].update({"^" + t[:n] for t in found for n in range(SHORTEST, min(len(t), LONGEST) + 1)})
        if len(count[0]) + len(count[1]) > 500_000:
            yield flush()
    yield flush()


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of five consecutive words, by which near copies mostly agree."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tb.least_shingles(b.column(1)))], names=["doc_id", "text", "toxic", "least"])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of about ``sample`` labelled documents at most, near copies thinned."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = marked.count()
    if known > sample:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / known))
    chosen = docs.select(F.col("doc_id").cast("bigint"), "text").where("text is not null").join(marked.select(F.col("doc_id").cast("bigint"), "toxic"), "doc_id")
    thin = chosen.mapInArrow(_thin, "doc_id bigint, text string, toxic int, least bigint")
    return thin.groupBy("least", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic")


def choose_lexicon(counts: pd.DataFrame, n_toxic: int, n_other: int) -> Lexicon:
    """Entries that mark toxic documents: see the module's docstring. ``counts`` has entry, toxic, other."""
    if not n_toxic or not n_other:
        return {}
    base = n_toxic / (n_toxic + n_other)
    toxic = dict(zip(counts["entry"], counts["toxic"], strict=True))
    other = dict(zip(counts["entry"], counts["other"], strict=True))

    def surprise(e: str) -> float:
        """Bits (base 10) by which the toxic share of the entry's documents exceeds chance (a Chernoff bound)."""
        t, n = toxic[e], toxic[e] + other[e]
        q = t / n
        if q <= base:
            return 0.0
        return n * (q * math.log10(q / base) + ((1 - q) * math.log10((1 - q) / (1 - base)) if q < 1 else 0.0))

    good = {e for e in toxic if toxic[e] >= 3 and toxic[e] >= 0.75 * (toxic[e] + other[e]) and surprise(e) >= 6.0}
    lexicon: Lexicon = {}
    children = defaultdict(list)
    for e in good:
        if e[0] == "^" and len(e) > SHORTEST + 1:
            children[e[:-1]].append(e)
    covered: list[str] = []
    for e in sorted((e for e in good if e[0] == "^"), key=lambda e: (len(e), e)):
        if e[:-1] in good and len(e) > SHORTEST + 1:
            continue
        while nxt := max((c for c in children[e] if toxic[c] >= 0.9 * toxic[e]), key=lambda c: toxic[c], default=None):
            e = nxt
        whole = "=" + e[1:]
        longer = [w for w in good if w[0] == "=" and w[1:].startswith(e[1:]) and toxic[w] >= 0.9 * toxic[e]]
        if whole in toxic and toxic[whole] >= 0.9 * toxic[e]:
            lexicon[e[1:]] = False
        elif longer:
            lexicon[max(longer, key=lambda w: (toxic[w], w))[1:]] = False
        else:
            lexicon[e[1:]] = True
        covered.append(e[1:])
    for w in sorted(w for w in good if w[0] == "="):
        if not any(w[1:].startswith(c) for c in covered):
            lexicon[w[1:]] = False
    return lexicon


def edits_allowed(entry: str) -> int:
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class Automaton:
    """The Levenshtein automata of the entries intersected with their trie, determinised on demand.

    A state is (a frozen set of (node, edits, awaited letter), the best match so far); awaited is the second letter of a swap.
    """

    def __init__(self, lexicon: Lexicon):
        self.next: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        self.deepest: list[int] = [0]  # edits allowed by any entry below a node
        self.begins = lexicon
        for e in sorted(lexicon):
            node = 0
            self.deepest[0] = max(self.deepest[0], edits_allowed(e))
            for c in e:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.entry.append(None)
                    self.deepest.append(0)
                node = self.next[node][c]
                self.deepest[node] = max(self.deepest[node], edits_allowed(e))
            self.entry[node] = e
        self._reset()

    def _reset(self) -> None:
        self.start = self._state(self._closed({(0, 0, "")}), None)
        self.moves: dict[tuple, dict[str, tuple]] = {}

    def _closed(self, states: set) -> frozenset:
        """Adds deletions: a letter of the entry is skipped."""
        todo, out = list(states), set()
        while todo:
            s = todo.pop()
            if s in out:
                continue
            out.add(s)
            node, e, await_ = s
            if not await_:
                todo += [(child, e + 1, "") for child in self.next[node].values() if e + 1 <= self.deepest[child]]
        return frozenset(out)

    def _state(self, states: frozenset, best: tuple | None) -> tuple:
        """Entries that stand for word beginnings match as soon as they are reached."""
        for node, e, await_ in states:
            entry = self.entry[node]
            if entry and not await_ and self.begins[entry] and e <= edits_allowed(entry) and (best is None or (e, entry) < best):
                best = (e, entry)
        return states, best

    def _move(self, state: tuple, c: str) -> tuple:
        states, best = state
        out = set()
        for node, e, await_ in states:
            if await_:
                if c == await_:
                    out.add((node, e, ""))
                continue
            if e + 1 <= self.deepest[node]:
                out.add((node, e + 1, ""))
            for letter, child in self.next[node].items():
                if letter == c:
                    out.add((child, e, ""))
                elif e + 1 <= self.deepest[child]:
                    out.add((child, e + 1, ""))
                    after = self.next[child].get(c)
                    if after is not None and e + 1 <= self.deepest[after]:
                        out.add((after, e + 1, letter))
        return self._state(self._closed(out), best)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, entry) of the closest entry within its allowed edits."""
        if len(self.moves) > 200_000:
            self._reset()
        state = self.start
        for c in word:
            if not state[0]:
                break
            row = self.moves.setdefault(state, {})
            if c not in row:
                row[c] = self._move(state, c)
            state = row[c]
        else:
            ends = [(e, self.entry[n]) for n, e, a in state[0] if self.entry[n] and not a and e <= edits_allowed(self.entry[n])]
            return min([*ends, *([state[1]] if state[1] else [])], default=None)
        return state[1]


class Matcher:
    """Matches of whole texts: (entry, misspelled, quoted), with the verdicts on words kept between rows."""

    def __init__(self, lexicon: Lexicon, window: int = 6, reach: int = 80):
        self.automaton, self.known, self.window, self.reach = Automaton(lexicon), {}, window, reach

    def __call__(self, text: str | None) -> Counter:
        out: Counter = Counter()
        low = (text or "").lower()
        found = set(TOKEN.findall(low))
        if len(self.known) > 100_000:
            self.known.clear()
        hits = set()
        for t in found:
            if t not in self.known:
                self.known[t] = self.automaton.match(t)
            if self.known[t] is not None:
                hits.add(t)
        if hits:
            before: list[str] = []
            for m in TOKEN.finditer(low):
                if (t := m[0]) in hits:
                    edits, entry = self.known[t]
                    out[entry, edits > 0, self._quoted(low, m.start(), m.end(), before)] += 1
                before = [*before[1 - self.window :], t]
        return out

    def _quoted(self, text: str, start: int, end: int, before: list[str]) -> bool:
        left, right = text[max(0, start - self.reach) : start].rpartition("\n")[2], text[end : end + self.reach].partition("\n")[0]
        opened = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
        return opened or not REPORTING.isdisjoint(before)


def _evidence(lexicon: Lexicon):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, count = Matcher(lexicon), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update((*key, toxic) for key in matcher(text))
        rows = list(zip(*[(*k, n) for k, n in count.items()], strict=True)) or [()] * 5
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["entry", "misspelled", "quoted", "toxic", "n"])

    return evidence


class Model:
    """The lexicon, the weight of each kind of match, and the prior log odds."""

    def __init__(self, lexicon: Lexicon, weights: dict[tuple[str, bool, bool], float], prior: float):
        self.lexicon, self.weights, self.prior = lexicon, weights, prior

    def score(self, found: Counter) -> float:
        total = self.prior + sum(self.weights[k] * min(2.0, 1 + math.log(n)) for k, n in found.items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Learns from ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers; at most about ``sample`` of them."""
    rows = staged(labelled_sample(docs, labels, sample), "sample")
    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    counts = rows.mapInArrow(_features, "entry string, toxic bigint, other bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lexicon = choose_lexicon(counts.where("toxic >= 3 and toxic >= 0.75 * (toxic + other)").toPandas(), n_toxic, n_other)
    seen: dict[tuple[str, bool, bool], list[int]] = defaultdict(lambda: [0, 0])
    got = rows.mapInArrow(_evidence(lexicon), "entry string, misspelled boolean, quoted boolean, toxic int, n bigint").groupBy("entry", "misspelled", "quoted", "toxic").agg(F.sum("n").alias("n"))
    for r in got.collect():  # at most eight rows an entry
        seen[r.entry, r.misspelled, r.quoted][r.toxic] = r.n
    odds = math.log((n_other + 1) / (n_toxic + 1))
    weights = {}
    for entry in lexicon:
        other, toxic = seen[entry, False, False]
        exact = math.log((toxic + 0.5) / (other + 0.5)) + odds
        for misspelled in (False, True):
            for quoted in (False, True):
                other, toxic = seen[entry, misspelled, quoted]
                # Unseen kinds inherit from the exact plain entry, at a discount; two documents of such prior evidence.
                guess = exact * (0.7 if misspelled else 1.0) * (0.3 if quoted else 1.0)
                share = 1 / (1 + math.exp(-(guess - odds)))
                weights[entry, misspelled, quoted] = math.log((toxic + 2 * share + 1e-3) / (other + 2 * (1 - share) + 1e-3)) + odds
    return Model(lexicon, weights, -max(odds, 1.5) - 0.5)


def _scorer(model: Model):
    lexicon, weights, prior = model.lexicon, model.weights, model.prior

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, held = Matcher(lexicon), Model(lexicon, weights, prior)
        for b in batches:
            got = np.array([held.score(matcher(t)) for t in b.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, held_out, text)."""
    return docs.select(F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(_scorer(model), _SCORED)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for b in batches:
            ok = [model.score(matcher(t)) < 0.5 for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 5, 0)
    model = fit(docs.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return scores(docs, model)


QUERIES = {"op6_toxicity": op6_toxicity}
