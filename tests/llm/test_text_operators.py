"""Quality rules, decontamination, near duplicates, repeats: exact against brute force, with odd rows."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaza.llm import decontaminate, graph, lsh_forest, mixing, quality_rules, repeats
from plaza.llm import textbytes as tb
from tests.llm import helpers as H

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts(spark, sf):
    """The first documents of the smallest table, and odd ones: null, empty, short, long, equal and near-equal."""
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 70").collect()}
    base = rows[2] + " " + rows[3]
    rows |= {1000: None, 1001: "", 1002: "one", 1003: "one", 1004: "two words", 1005: base, 1006: base + " tail", 1007: base, 1008: " \n\t ", 1009: (rows[5] + "\n") * 60, 1010: "é" * 70, 1011: "x" + "é" * 70}
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    df = spark.createDataFrame([(d, t, "en" if d % 3 else None, f"s{d % 3}", 1) for d, t in texts.items()], DOCS)
    # Columns that clash with names the operators use.
    return df.withColumns({"n_words": F.lit(1), "rep": F.lit("x"), "bucket": F.lit(2), "stratum": F.lit(3), "n_hit": F.lit(9)}).repartition(3)


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_word_hashes_and_shingles():
    data, offsets = tb.flat(pa.array(["ab cd ab", None, "", "ab"]))
    starts, ends, owner = tb.words(data, offsets, tb.alnum_class())
    h = tb.word_hashes(data, starts, ends)
    assert owner.tolist() == [0, 0, 0, 3] and h[0] == h[2] == h[3] != h[1]
    s, r = tb.shingle_hashes(h, owner, 4, 2)
    assert r.tolist() == [0, 0, 3]
    assert [c.tolist() for c in tb.words(*tb.flat(pa.array([], pa.string())), tb.alnum_class())] == [[], [], []]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == 0 and got[201] == got[200] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, texts, docs):
    long_item = " ".join(H.words(texts[4])[3:25])
    items = [(1, long_item), (2, "two words"), (3, None), (4, ""), (5, " ".join(H.words(texts[6])[:12])), (5, " ".join(H.words(texts[6])[:12])), (6, "ONE"), (7, " ".join(H.words(texts[7])[5:12])), (30, "not in any text at all " * 3)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("doc", "key", "words", "pos", "size", "held", "start", "length", "item_ids", "n_keys", "copies", "_words", "_key", "_doc")})
    out = decontaminate.contamination(clash, bench)
    got = rows(out, "doc_id", "n_words", "n_hit", "item_ids")
    want = H.contamination(texts, items)
    assert got == {d: (n, h, sorted(map(str, i))) for d, (n, h, i) in want.items()}
    assert got[4][1] >= 22 and got[1004][1] == 2 and out.where("doc <> 'x' or _key <> 'x' or rep <> 'x'").count() == 0
    kept = decontaminate.without_contaminated(clash, bench)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if not x[1]}
    none = decontaminate.contamination(docs.select("doc_id", "text"), spark.createDataFrame([], "item_id int, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(texts)
    assert decontaminate.contamination(docs.select("doc_id", "text").limit(0), bench).count() == 0


def test_decontamination_in_blocks_and_repeated(spark, texts):
    twice = spark.createDataFrame([(1, texts[4]), (1, texts[4]), (None, texts[4]), (1, "another text of the same id")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(H.words(texts[4])[:15])), (10, "same id")], "item_id int, text string")
    got = decontaminate.contamination(twice, items)
    assert sorted(r.n_hit for r in got.collect()) == [2, 15, 15, 15]
    assert decontaminate.without_contaminated(twice, items).count() == 0
    keyed = twice.where("text is not null").select(F.struct("doc_id", F.length("text").alias("key")).alias("doc"), decontaminate.words_of(F.col("text")).alias("words"))
    a = {tuple(r) for r in decontaminate.find_windows(keyed, items, keys_per_scan=3)[1].collect()}
    assert a == {tuple(r) for r in decontaminate.find_windows(keyed, items)[1].collect()} and len(a) == 2 * 6 + 1


def test_near_duplicates(docs, texts):
    clash = docs.withColumns({c: F.lit("x") for c in ("set_id", "grp", "node", "copies", "class", "text_key", "n", "block")})
    got = rows(lsh_forest.near_duplicates(clash), "doc_id", "class_id", "n_links")
    assert got == H.near_duplicates(texts)
    split = rows(lsh_forest.near_duplicates(docs, block_docs=2, node_block=2), "doc_id", "class_id", "n_links")  # groups and nodes of several cells
    assert split == got
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_odd_ids(spark, texts):
    a, b = texts[2], texts[3]
    data = [(None, a), (1, a), (1, a), (2, a + " more"), (3, b), (3, "zz " + a), (4, b + " x"), (None, "alone"), (5, None), (5, None)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"))
    found = sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts, r.n_copies) for r in got.collect()), key=str)
    # Documents are (id, text): 1, 2 and the second text of 3 are one class, 4 and the first text of 3 another.
    want = [(None, None, 3, 2, 1), (1, 1, 2, 2, 1), (1, 1, 2, 2, 1), (2, 1, 2, 2, 1), (3, 3, 1, 1, 1), (3, 1, 2, 2, 1), (4, 3, 1, 1, 1), (None, None, 0, 0, 1), (5, 5, 0, 0, 1), (5, 5, 0, 0, 1)]
    assert found == sorted(want, key=str)
    first = [(r.doc_id, r.class_id) for r in got.where("is_first and doc_id is not null").collect()]
    assert sorted(first) == [(1, 1), (1, 1), (3, 3), (5, 5), (5, 5)]


def test_prefixes_shorten_to_the_recall_of_each_size():
    # A set of 6 that is linked to another has at least 5/6 in common, one of up to 3 has no such partner.
    assert [lsh_forest.least_similarity(n, 0.8) for n in (1, 3, 4, 6, 8)] == [1.0, 1.0, 0.8, pytest.approx(5 / 6), 0.8]
    found = lsh_forest.shortest_prefixes(32, 8, 0.8, 0.9999)
    assert found[3] == 9 and found[-1] == 6 and found[7] > 6
    for n in range(4, len(found)):
        assert 1 - (1 - lsh_forest.least_similarity(n, 0.8) ** float(found[n])) ** 32 >= 0.9999


def test_intersections_equal_sets():
    rng = np.random.default_rng(8)
    sets = [set(rng.integers(0, 60, 20).tolist()) | set(rng.integers(60, 9000, 30).tolist()) for _ in range(150)]
    entries = lambda some: (np.array([i for i, x in enumerate(some) for _ in x]), np.array([h for x in some for h in x], np.uint64))
    a, b = sets[:70], sets[50:]
    for rare in (3, 48):
        assert lsh_forest.intersections(*entries(a), len(a), *entries(b), len(b), rare).tolist() == [[len(x & y) for y in b] for x in a]


def test_walk_of_a_node_equals_all_pairs():
    """Groups after the walk of a trie node against all pairs that share an allowed prefix."""
    rng = np.random.default_rng(6)
    for _ in range(40):
        m, floor, depth, most = 30, 2, 4, 10
        values, sides = rng.integers(0, 3, (m, 2)), rng.integers(0, int(rng.integers(1, 3)), m)
        tail = (values[:, 0] << 31 | values[:, 1]).astype(np.uint64)
        order = np.argsort(tail, kind="stable")
        tail, values = tail[order], values[order]
        shortest, group = rng.integers(2, 6, m), rng.integers(0, 20, m)
        centre = rng.integers(0, 1 << 63, (6, lsh_forest.SKETCH)).astype(np.uint64)
        sketch = centre[rng.integers(0, 6, m)] ^ (np.uint64(1) << rng.integers(0, 60, (m, lsh_forest.SKETCH)).astype(np.uint64))
        links = lsh_forest.link_node(group, sides, tail, shortest, sketch, floor, depth, most)
        two = len(set(sides)) > 1

        def parts(pairs, m=m, group=group):
            at = list(range(m))
            for a, b in [*pairs, *[(a, b) for a in range(m) for b in range(a) if group[a] == group[b]]]:
                at = [at[a] if x == at[b] else x for x in at]
            return {frozenset(i for i in range(m) if at[i] == x) for x in at}

        want = []
        for a in range(m):
            for b in range(a):
                shared = 2 if values[a, 0] != values[b, 0] else 3 if values[a, 1] != values[b, 1] else 4
                bits = int(np.bitwise_count(sketch[a] ^ sketch[b]).sum())
                if shared >= max(shortest[a], shortest[b]) and bits <= most and not (two and sides[a] == sides[b]):
                    want.append((a, b))
        assert parts(links) == parts(want) and all(np.bitwise_count(sketch[a] ^ sketch[b]).sum() <= most for a, b in links)


def test_recall_of_forest(spark):
    """Pairs around the threshold, against all pairs."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = {}
    for g in range(20):
        base = list(rng.choice(vocabulary, 200))
        for k in range(4):
            copy = base.copy()
            for at in rng.choice(200, k * 2, replace=False):
                copy[at] = str(rng.choice(vocabulary))
            texts[g * 10 + k] = " ".join(copy)
    got = rows(lsh_forest.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")), "doc_id", "class_id", "n_links")
    assert got == H.near_duplicates(texts)
    assert lsh_forest.prefix_length(32, 8, 0.8, 0.9999) == 6 and lsh_forest.prefix_length(4, 8, 0.8, 0.99) < 3


def test_repeats(docs, texts):
    got = rows(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == H.without_repeats(texts)
    many = rows(repeats.remove_repeats(docs, bucket_bytes=20_000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert many == got
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_in_segments(spark, texts, monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 900)
    some = {d: texts[d] for d in (2, 3, 5, 1005, 1006, 1009)}
    df = spark.createDataFrame(list(some.items()), "doc_id bigint, text string")
    assert rows(repeats.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == H.without_repeats(some)


def test_maximal_repeats(spark):
    rng = np.random.default_rng(2)
    line = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = line(55)
    df = spark.createDataFrame([(1, line(80) + "<" + shared + ">" + line(70)), (2, line(60) + "[" + shared + "]"), (3, shared + line(90)), (4, line(120))], "doc_id bigint, text string")
    got = repeats.maximal_repeats(df).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.repeat_id, []).append(r)
    text = {r.doc_id: r.text for r in df.collect()}
    covered = {d: set() for d in text}
    for g in groups.values():
        assert len({text[r.doc_id][r.start : r.start + r.length] for r in g}) == 1 and g[0].length >= 50
        assert {r.doc_id for r in g} == {1, 2, 3}  # all occurrences
        for r in g:
            covered[r.doc_id] |= set(range(r.start, r.start + r.length))
    assert covered == {1: set(range(81, 136)), 2: set(range(61, 116)), 3: set(range(55)), 4: set()}


def test_lcp_intervals():
    lo, hi, depth, parent = repeats.lcp_intervals(np.array([3, 5, 5, 0, 4, 2]), 2)
    assert sorted(zip(lo.tolist(), hi.tolist(), depth.tolist(), parent.tolist(), strict=True)) == [(0, 3, 3, 1), (1, 3, 5, 3), (4, 5, 4, 2), (4, 6, 2, 1)]


def test_quality_measures():
    assert quality_rules.text_measures(None) == (0, 0, 0, 0, 0, 0)
    assert quality_rules.text_measures("a b c a b c\na b c a b c\n\n#x") == (13, 14, 1, 1, 12, 3)
    assert quality_rules.text_measures("a b c d a b c")[4] == 6


def test_binomial_bounds():
    p = 0.1
    tail = sum(math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(4))
    assert quality_rules.binomial_tail(3, 20, p) == pytest.approx(tail)
    u = quality_rules.upper_bound(3, 20, 0.05)
    assert quality_rules.binomial_tail(3, 20, u) == pytest.approx(0.05, rel=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def quality_table(spark, n=2000):
    """Good and bad texts with words of their own, odd rows, and columns that clash."""
    good = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    bad = lambda i: " ".join(f"word{i}x{k}%%%" for k in range(60))
    rows = [(i, bad(i) if i % 10 == 0 else good(i), "en", "s", 1) for i in range(n)]
    rows += [(9000, None, None, None, None), (9001, "short", "en", "s", 1), (9002, "a b c " * 40, "en", "s", 1), (9003, good(1), None, "s", 1), (7, good(7), "en", "s", 1), (9004, "long%%% " + good(3) * 400, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("stratum", "n_words", "least", "half", "good", "limits", "kept")})
    labels = [(i, int(i % 10 != 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0), (99999, 1, 0), (11, 0, 0), (11, 1, 0)]
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_rules_certify_and_judge(spark):
    docs, labels = quality_table(spark)
    measured = quality_rules.measures(docs)
    cut = {r.rule: r for r in quality_rules.fit_cutoffs(measured, labels).where("stratum = 'en'").collect()}
    assert cut["symbol_ratio"].cutoff is not None and cut["symbol_ratio"].bound <= 0.01 and cut["symbol_ratio"].n_lost == 0
    assert cut["repeat_ratio"].cutoff is None
    out = {r.doc_id: r for r in quality_rules.judge(measured, quality_rules.fit_cutoffs(measured, labels)).collect()}
    assert not out[10].kept and out[11].kept and out[9000].base_failed and out[9001].base_failed and out[9002].base_failed and out[9003].kept
    assert out[9004].n_words == 1 + 60 + 399 * 59 and len(out) == 2000 + 5
    # Too few labels certify nothing, and copies are no labels of their own.
    few = quality_rules.fit_cutoffs(measured, labels.where("doc_id < 50"))
    assert few.where("rung > 0").count() == 0
    text = docs.first().text
    same = spark.createDataFrame([(i, text + "%" if i % 10 == 0 else text, "en", "s", 1) for i in range(2000)], DOCS)
    assert quality_rules.fit_cutoffs(quality_rules.measures(same), labels).where("rung > 0").count() == 0
    none = quality_rules.judge(measured, quality_rules.fit_cutoffs(measured, labels.limit(0)))
    assert none.where("kept").count() == 2000 + 2
    empty = quality_rules.measures(docs.limit(0))
    assert quality_rules.judge(empty, quality_rules.fit_cutoffs(empty, labels)).count() == 0


def test_quality_joint_verdict_is_certified(spark):
    """A rule that would drop too many of the good documents is off, or keeps a cutoff that is lax enough."""
    docs, labels = quality_table(spark)
    measured = quality_rules.measures(docs)
    assert quality_rules.holdout(measured, labels).where("kind = 'good'").agg(F.sum("n")).first()[0] <= 1800
    # Half of the good documents have symbols, as many as bad ones have: nothing is safe.
    at = lambda ratio: (F.col("n_words") * ratio).cast("bigint")
    half = (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 2000)
    assert quality_rules.fit_cutoffs(measured.withColumn("n_symbols", F.when(half, at(3.0)).otherwise(F.col("n_symbols"))), labels).where("rung > 0").count() == 0
    # They have some symbols, so only lax cutoffs are safe.
    some = measured.withColumn("n_symbols", F.when(half, at(0.7)).otherwise(F.col("n_symbols")))
    cut = {r.rule: r for r in quality_rules.fit_cutoffs(some, labels).collect()}["symbol_ratio"]
    assert cut.rung in (1, 2, 3, 4) and cut.cutoff == quality_rules.RULES["symbol_ratio"][1][cut.rung - 1] > 0.7 and cut.n_lost == 0
    judged = quality_rules.judge(some, quality_rules.fit_cutoffs(some, labels)).where("stratum = 'en' and not base_failed").withColumn("ratio", F.col("n_symbols") / F.col("n_words"))
    assert judged.where(F.col("kept") == (F.col("ratio") >= cut.cutoff)).count() == 0


def test_the_path_never_looks_at_outcomes_of_good_documents():
    rng = np.random.default_rng(4)
    for _ in range(30):
        kind = np.array(["good", "bad", "none"])[rng.integers(0, 3, 60)]
        n, levels = rng.integers(1, 50, 60), {r: rng.integers(1, len(x) + 2, 60) for r, (_, x) in quality_rules.RULES.items()}
        path = quality_rules.choose_path(levels, n, kind, 0.5, 0.01)
        other = {r: np.where(kind == "good", rng.permutation(v), v) for r, v in levels.items()}
        assert quality_rules.choose_path(other, n, kind, 0.5, 0.01) == path
        for one, two in zip([{}, *path], path, strict=False):
            assert all(two[r] >= k for r, k in one.items()) and one != two


def brute_force_quality(rows, labels, risk=0.01, alpha=0.05, weight=0.5):
    """(doc_id, least, lang, text) rows -> {(doc_id, text): (measures, base_failed, kept)}, by the values and cutoffs themselves."""
    seen = {(r.doc_id, r.text): quality_rules.text_measures(r.text) for r in rows}
    base = {k: m[0] < 50 or 100 * m[4] > 50 * m[0] for k, m in seen.items()}

    def beyond(m, rule, cutoff):
        n, x = max(1, m[0]), {"symbol_ratio": m[2], "dup_line_ratio": m[3], "repeat_ratio": m[4]}.get(rule, m[1])
        x = x / max(1, m[5]) if rule == "dup_line_ratio" else x / n
        return x >= cutoff if quality_rules.RULES[rule][0] > 0 else x <= cutoff

    value = {}
    for d, q in labels:
        if d is not None and q is not None:
            value[d] = min(value.get(d, q), q)
    thin = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, len((r.text or "").split()))):
        if not base[r.doc_id, r.text]:
            thin.setdefault((r.lang or "und", None if r.doc_id not in value else value[r.doc_id] > 0, r.least), seen[r.doc_id, r.text])
    of = lambda s, kind: [m for k, m in thin.items() if k[:2] == (s, kind)]
    sizes = sorted(((-len(of(s, True)), s) for s in {k[0] for k in thin} if of(s, True)))
    m = max((k for k, (n, _) in enumerate(sizes, 1) if (1 - risk) ** -n <= alpha / k), default=0)
    tail = lambda k, n: sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
    chosen = {}
    for _, s in sizes[:m]:
        good, bad, none = of(s, True), of(s, False), of(s, None)
        goals, rules, share = [], {}, len(bad) / (len(good) + len(bad))
        for k, (rule, (_, ladder)) in enumerate(quality_rules.RULES.items()):
            gains = []
            for at, c in enumerate(ladder):
                caught, hit = (sum(beyond(x, rule, c) for x in xs) / max(1, len(xs)) for xs in (bad, none))
                lost = max(0.0, hit - share * caught) / (1 - share)
                gains.append((-(caught - weight * max(0.0, lost - risk / 2) / risk), at))
            if bad and min(gains)[0] < 0:
                goals.append((min(gains)[0], k, rule, min(gains)[1]))
        walking = True
        for _, _, rule, goal in sorted(goals):
            for c in quality_rules.RULES[rule][1][: goal + 1]:
                out = lambda x, now: any(beyond(x, r, v) for r, v in now.items())
                if walking and any(beyond(x, rule, c) and not out(x, rules) for x in bad):
                    more = rules | {rule: c}
                    walking = tail(sum(out(x, more) for x in good), len(good)) <= alpha / m
                    rules = more if walking else rules
        chosen[s] = rules
    return {(r.doc_id, r.text): (seen[r.doc_id, r.text], base[r.doc_id, r.text], not base[r.doc_id, r.text] and not any(beyond(seen[r.doc_id, r.text], x, c) for x, c in chosen.get(r.lang or "und", {}).items())) for r in rows}


def test_op1_equals_brute_force(spark, sf, tmp_path):
    """The query on the smallest table and on one with labels enough to certify a rule."""
    docs, labels = quality_table(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for folder in (sf, f"{tmp_path}"):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        hashed = quality_rules.measures(docs).select("doc_id", "least").distinct()
        rows = docs.join(hashed, "doc_id").collect()
        marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
        want = sorted((k[0], m[:5], b, x) for k, (m, b, x) in brute_force_quality(rows, marks).items())
        got = {(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in quality_rules.op1_quality_rules(spark, folder).collect()}
        assert sorted(got) == want
    assert sum(not x for _, _, b, x in want if not b) >= 190


def test_mixing_meets_goals(spark):
    sizes = {"a": 900, "b": 200, "c": 50, None: 25}
    data = [(i * 10_000 + k, s, 10 + k % 7) for i, (s, n) in enumerate(sizes.items()) for k in range(n)] + [(1, "empty", 0), (2, "empty", 0)]
    docs = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint").withColumn("extra", F.lit("x"))
    totals = mixing.source_tokens(docs)
    t = mixing.exponent(totals, 0.95, 3.0)
    w = {r.source: r for r in mixing.weights(totals, t).collect()}
    tokens = {r.source: r.tokens for r in totals.collect()}
    use = {s: r.epochs for s, r in w.items() if tokens[s]}
    assert max(use.values()) <= 3.0 * (1 + 1e-3) and min(use.values()) == pytest.approx(1.0)
    assert max(use.values()) == pytest.approx(3.0, rel=1e-2)  # repeats bind here, as entropy would need more
    out = mixing.mix(docs, 0.95, 3.0).collect()
    assert len(out) == len(data)
    for s in sizes:
        taken = sum(r.copies * r.n_tokens for r in out if r.source == s)
        assert 0 <= w[s].epochs * tokens[s] - taken < 17
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5), 0.95, 3.0).collect()}
    assert again == {(r.doc_id, r.copies) for r in out}
    assert mixing.mix(docs.limit(0)).count() == 0
    only = mixing.mix(docs.where("source = 'a'"))
    assert {r.copies for r in only.collect()} == {1}


def test_mixing_budget_by_brute_force(spark):
    docs = spark.createDataFrame([(i, "a" if i % 4 else "b", 1 + i % 5) for i in range(400)], "doc_id bigint, source string, n_tokens bigint")
    totals = mixing.source_tokens(docs)
    out = mixing.realise(docs, mixing.weights(totals, 0.0, budget=900), block_docs=30).collect()
    for s in "ab":
        taken = sum(r.copies * r.n_tokens for r in out if r.source == s)
        assert 450 - 5 <= taken <= 450


def test_queries_run_whole_tables(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for module in (quality_rules, decontaminate, lsh_forest, mixing, repeats):
        for name, fn in module.QUERIES.items():
            assert fn(spark, sf).count() == n, name


def test_op2_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows(decontaminate.op2_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = {d: (n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, (n, h, i) in H.contamination(texts, items).items()}
    assert got == want
