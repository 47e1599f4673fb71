"""Queries that SQL cannot express, over whole tables, against plain versions of what they compute."""

import itertools
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaza.llm import html_cut, language_id, mixing, toxicity
from tests.llm.test_models_and_files import DOCS, PAGE, distance, labelled


def test_op4_equals_the_plain_recursion(spark, sf):
    """All segmentations of every word of every text, one word after another."""
    docs = language_id.with_held_out(spark.read.parquet(f"{sf}/documents.parquet"), 4, 2)
    pieces = language_id.vocabulary()
    model = language_id.train(docs.where("not held_out"), pieces)
    names, known, longest = sorted(model), {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    logp = [[math.log(x) for x in model[n]] for n in names]
    seen: dict[bytes, list[float]] = {}

    def word_logs(word):
        if word not in seen:
            cells = [(j, i, known.get(word[i:j], -1)) for j in range(1, len(word) + 1) for i in range(max(0, j - longest), j) if word[i:j] in known or i == j - 1]
            seen[word] = []
            for p in logp:
                at = [0.0] + [-math.inf] * len(word)
                for j, group in itertools.groupby(cells, lambda c: c[0]):
                    x = [at[i] + p[k] for _, i, k in group]
                    at[j] = max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
                seen[word].append(at[-1])
        return seen[word]

    got = {r.doc_id: r for r in language_id.op4_language_id(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, total = got[doc_id], [0.0] * len(names)
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        for w, n in Counter(re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))).items():
            total = [t + n * x for t, x in zip(total, word_logs(b" " + w), strict=True)]
        if not any(map(str.isalpha, text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(total)
        assert r.score == pytest.approx(1 / sum(math.exp(t - best) for t in total), abs=1e-6)
        if r.score > 0.5 + 1e-6:
            assert r.lang_pred == names[total.index(best)]


def test_op5_equals_the_cheapest_labelling(spark, tmp_path):
    """Every labelling of the blocks of small pages."""
    long = "plain words of a text that goes on for a while and does not say much about anything, "
    html = [
        PAGE, None, "", f"<p>{long}</p>", f"<div><p>{long * 3}</p><div>Short remark.</div><p>{long * 2}</p></div>", "<ul><li><a href=x>one</a><li><a href=y>two</a><li>three words here</ul>" + long,
        f"<article><h2>Head</h2><div class='legal tags'>{long}</div><p>{long}</p><div class=ad><p>Buy {long}</p></div></article><div class=side>{long}</div>", f"<div class=comments><p>{long}</p></div><td>x</td>{long}",
    ]
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, long + "\n" + long * 3), (2, "First paragraph goes on & on with enough words to be one.\nSecond bold text here, with a link in it.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages, docs = spark.read.parquet(f"{tmp_path}/pages.parquet"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    score = html_cut.Classifier(html_cut.fit(pages, docs))
    want = []
    for h in html:
        found = html_cut.blocks(h or "")
        x, edges = [score(b) for b in found], html_cut.smoothness(found)
        cost = lambda lab: sum(-s if y and s < 0 else s if not y and s > 0 else 0 for s, y in zip(x, lab, strict=True)) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])  # noqa: B023, E731
        best = min(itertools.product([True, False], repeat=len(found)), key=cost)
        want.append("\n".join(b.text for b, y in zip(found, best, strict=True) if y))
    got = {r.page_id: (r.text, r.n_chars) for r in html_cut.op5_html_cut(spark, str(tmp_path)).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(want)} and sum(map(bool, want)) >= 4


def test_op6_equals_edit_distances(spark, tmp_path):
    """Every word of every text against every entry by a table of edit distances."""
    docs, labels = labelled(spark, 600)
    odd = [(1000, None), (1001, ""), (1002, 'they said "idoit" and mor0n'), (1003, "moorn " * 300), (1004, "idiots and morons"), (None, "an idiot"), (1005, "a quoted word: idiot"), (1005, "fine")]
    docs = docs.unionByName(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in odd], DOCS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = toxicity.with_held_out(spark.read.parquet(f"{tmp_path}/documents.parquet"), 5, 0)
    model = toxicity.fit(docs.where("not held_out").select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"idiot", "moron"} <= set(model.lexicon)

    def closest(word):
        found = []
        for entry, begins in model.lexicon.items():
            d = min(distance(word[:n], entry) for n in range(len(word) + 1)) if begins else distance(word, entry)
            if d <= toxicity.edits_allowed(entry):
                found.append((d, entry))
        return min(found, default=None)

    known, want = {}, []
    for r in docs.collect():
        low, matches, words = (r.text or "").lower(), Counter(), []
        for m in toxicity.TOKEN.finditer(low):
            if m[0] not in known:
                known[m[0]] = closest(m[0])
            if known[m[0]]:
                left, right = low[max(0, m.start() - 80) : m.start()].split("\n")[-1], low[m.end() : m.end() + 80].split("\n")[0]
                quoted = (any(q in left for q in toxicity.QUOTES) and any(q in right for q in toxicity.QUOTES)) or bool(set(words[-6:]) & toxicity.REPORTING)
                matches[known[m[0]][1], known[m[0]][0] > 0, quoted] += 1
            words.append(m[0])
        total = model.prior + sum(model.weights[k] * min(2.0, 1 + math.log(n)) for k, n in matches.items())
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        want.append((str(r.doc_id), held, round(score, 9), int(score >= 0.5)))
    got = [(str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(x[3] for x in want) > 50


def brute_force_mix(rows, min_entropy=0.95, max_repeats=2.0, seed_block=2000):
    """(doc_id, source, n_tokens, block hash, order hash) rows and the order of blocks -> copies of each row."""
    tokens, docs = Counter(), Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
        docs[r.source] += 1
    some = {s: n for s, n in tokens.items() if n}

    def state(t):
        x = {s: n**t for s, n in some.items()}
        z = sum(x.values())
        h = -sum(v / z * math.log(v / z) for v in x.values()) / math.log(len(x)) if len(x) > 1 else 1.0
        use = [x[s] / some[s] for s in some]
        return h, max(use) / min(use)

    def bisect(ok):  # the largest t in [0, 1] with ok(t), which holds up to some t
        lo, hi = 0.0, 1.0
        if ok(1.0):
            return 1.0
        for _ in range(60):
            lo, hi = ((lo + hi) / 2, hi) if ok((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return lo

    by_entropy = bisect(lambda t: state(t)[0] >= min_entropy)
    by_repeats = 1 - bisect(lambda u: state(1 - u)[1] <= max_repeats)
    return max(by_entropy, by_repeats), tokens, docs


def test_op8_equals_a_plain_mix(spark, sf):
    """Exponent by plain bisection, then whole blocks in their order while they fit, and single documents of the block at the edge."""
    docs = mixing.with_tokens(spark.read.parquet(f"{sf}/documents.parquet"))
    assert all(r.n_tokens == len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "")) for r in docs.collect())
    # One source gets many documents more, so that several blocks and a rest of repeats are there.
    more = docs.where("n_tokens > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).select((F.col("doc_id") * 100 + F.col("k") + 100_000).alias("doc_id"), F.lit("many").alias("source"), "n_tokens")
    every = docs.select("doc_id", "source", "n_tokens").unionByName(more)
    rows = every.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(11)).alias("place"), F.xxhash64("doc_id", F.lit(13)).alias("turn")).collect()
    t, tokens, count = brute_force_mix(rows)
    totals = mixing.source_tokens(every)
    assert mixing.exponent(totals) == pytest.approx(t, abs=1e-4)
    weighted = mixing.weights(totals, mixing.exponent(totals)).collect()
    epochs = {r.source: r.epochs for r in weighted}
    top = {s: n ** mixing.exponent(totals) for s, n in tokens.items() if n}
    scale = max(tokens[s] / top[s] for s in top)
    assert all(epochs[s] == pytest.approx(scale * top[s] / tokens[s], rel=1e-6) for s in top)
    blocks = {s: -(-n // 2000) for s, n in count.items()}
    names = spark.createDataFrame([(s, b) for s in count for b in range(blocks[s])], "source string, block int")
    order = {(r.source, r.block): r.h for r in names.select("source", "block", F.xxhash64("source", "block", F.lit(12)).alias("h")).collect()}
    want = {}
    for s in count:
        mine, whole = {}, math.floor(epochs[s])
        for r in (r for r in rows if r.source == s):
            mine.setdefault(r.place % blocks[s], []).append(r)
        rest, used = (epochs[s] - whole) * tokens[s], 0
        for b in sorted(mine, key=lambda b: (order[s, b], b)):  # noqa: B023
            size, room, taken = sum(r.n_tokens for r in mine[b]), rest - used, 0
            for r in sorted(mine[b], key=lambda r: (r.turn, r.doc_id)):
                taken += r.n_tokens
                fits = room >= size or (room > 0 and taken <= room)
                want[r.doc_id] = whole + int(fits)
            used += size
    got = {r.doc_id: r.copies for r in mixing.mix(every).collect()}
    assert got == want and len(set(want.values())) > 1
    assert {r.doc_id: r.copies for r in mixing.op8_mixing(spark, sf).collect()} == {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "source", "n_tokens")).collect()}
