"""Spelling variants against all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

from plaza.llm import spelling as SP

RUN, LOWER = re.compile("[A-Za-zÀ-ÿ]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = counted(rows)
    close = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def result(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in SP.op13_spelling(spark, str(tmp_path)).collect()}


def test_equals_all_pairs_on_dense_words(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=600))) for i in range(30)]
    rows += [(None, "Lettering lettering lettering-lettering lettring×lettring letteringg"), (3, None), (4, ""), (5, "aaaaaaaa aaaaaaa aaaaaaaaa " * 3), (5, "aaaaaaaa aaaaaaa aaaaaaaaa " * 3), (6, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5001)]
    got = result(spark, tmp_path, rows)
    assert got == plain(rows) and sum(r[4] for r in got) > 500


def test_forms_lead_to_roots(spark, tmp_path):
    chain = ["planetary", "planetery", "planetory", "plametory", "plamettory"]
    rows = [(10_000 + i, w) for k, w in enumerate(chain) for i in range(2 * 11 ** (3 - k) if k < 4 else 0)] + [(7, "plamettory plamettory")]
    got = result(spark, tmp_path, rows)
    assert got == plain(rows) and max(sum(1 for r in got if r[2] == root) for root in {r[2] for r in got}) >= 3


def test_whole_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in SP.op13_spelling(spark, sf).collect()} == plain(docs)


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []) == set()


def test_pivots_are_the_cheapest_disjoint_ones():
    rng = random.Random(1)
    for _ in range(300):
        firsts, lasts = ([(i, rng.randint(1, 9)) for i in sorted(rng.sample(range(k, 12 + k), rng.randint(3, 6)))] for k in (0, 4))
        costs = {(a, b): x + y for a, x in firsts for b, y in lasts if b - a >= 2}
        assert costs[SP.pivots(firsts, lasts)] == min(costs.values())
