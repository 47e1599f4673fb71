"""Language ID, toxicity, HTML, WARC archives, token files and the pipeline."""

import itertools
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plaza.llm import html_cut, language_id, token_files, toxicity, warc_zip
from plaza.llm.shared import shared_dir
from tests.llm import helpers as H

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def all_segmentations(word, pieces, p):
    """(summed probability, expected uses of each piece times that sum), over all segmentations."""
    total, used = 0.0, np.zeros(len(pieces))
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(x in pieces for x in parts):
            q = np.prod([p[pieces.index(x)] for x in parts])
            total += q
            for x in parts:
                used[pieces.index(x)] += q
    return total, used


def test_forward_sums_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b"aba"]
    seg = language_id.Segmenter(pieces)
    p = np.append(np.linspace(0.05, 0.3, len(pieces)), 1e-8)
    words = [b" abab", b" bab", b" a"]
    data, widths = np.frombuffer(b"".join(words), np.uint8), np.array([5, 4, 2])
    got, used = seg.forward(data, widths, np.log(p)[:, None]), seg.expected(data, widths, np.log(p)[:, None], np.array([2.0, 1.0, 3.0]))
    want = [all_segmentations(w, pieces, p) for w in words]
    assert np.exp(got[:, 0]) == pytest.approx([t for t, _ in want])
    assert used[: len(pieces)] == pytest.approx(sum(n * u / t for n, (t, u) in zip((2, 1, 3), want, strict=True)))


def test_long_words_are_summed_without_cuts():
    """A word of 200 bytes, and one longer than a block, against the plain recursion in big floats."""
    pieces = language_id.vocabulary()
    assert max(map(len, pieces)) > 12  # no piece is left out
    seg, rng = language_id.Segmenter(pieces), np.random.default_rng(3)
    p = rng.random((len(pieces) + 1, 2)) / len(pieces)
    p[-1] = 1e-8
    known = {x: i for i, x in enumerate(pieces)}
    for word in (b" " + b"unbelievably" * 17, ("é中文字dieses" * 700).encode()):
        alpha = [np.zeros(2)]
        for j in range(1, len(word) + 1):
            x = [alpha[i] + np.log(p[known.get(word[i:j], -1)]) for i in range(max(0, j - seg.longest), j) if word[i:j] in known or i == j - 1]
            alpha.append(np.logaddexp.reduce(x, axis=0))
        data = np.frombuffer(word, np.uint8)
        assert seg.forward(data, np.array([len(word)]), np.log(p))[0] == pytest.approx(alpha[-1])
        assert seg.forward_giant(data, np.log(p)) == pytest.approx(alpha[-1])


def test_slices_of_texts_do_not_change_scores(monkeypatch):
    pieces = language_id.vocabulary()
    model = {x: np.append(np.random.default_rng(k).random(len(pieces)), 1e-8) for k, x in enumerate(("a", "b"))}
    texts = ["some words here", None, "", "x" * 500 + " y", "12 34", "längere wörter " * 200, "中" * 300, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], names=["doc_id", "held_out", "text"])
    whole = next(language_id._scorer(pieces, model)(iter([batch]))).to_pylist()
    pieces_of = language_id.pieces_of
    monkeypatch.setattr(language_id, "pieces_of", lambda d, o: pieces_of(d, o, 40))
    monkeypatch.setattr(language_id, "_KNOWN", 3)
    monkeypatch.setattr(language_id, "_GIANT", 100)
    cut = next(language_id._scorer(pieces, model)(iter([batch]))).to_pylist()
    assert [r["lang_pred"] for r in cut] == [r["lang_pred"] for r in whole]
    assert [r["score"] for r in cut] == pytest.approx([r["score"] for r in whole])


def test_language_id(spark):
    en = "the quick brown fox jumps over the lazy dog and runs away from the other animals in this field"
    fr = "le renard brun saute par dessus le chien paresseux et court vers les autres animaux dans ce champ"
    data = [(i, en if i % 2 else fr, "en" if i % 2 else "fr", "s", 1) for i in range(200)]
    odd = [(900, None, "en", "s", 1), (901, "", "fr", "s", 1), (902, "123 !? 456", "en", "s", 1), (903, "the dog " * 5000, None, None, None), (904, "中文", None, "s", 1), (None, en, "en", "s", 1), (905, "x" * 100, "en", "s", 1)]
    docs = language_id.with_held_out(spark.createDataFrame(data + odd, DOCS).withColumn("score", F.lit(3)), 4, 2)
    pieces = language_id.vocabulary()
    model = language_id.train(docs.where("not held_out"), pieces)
    out = language_id.identify(docs, model, pieces)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(200))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "en" and got[904].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].held_out is False
    assert language_id.train(docs.limit(0), pieces) == {}
    none = language_id.identify(docs, {}, pieces)
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, pieces).count() == 0


def test_language_held_out_accuracy(spark, sf):
    got = language_id.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.9


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    entries = ["idiot", "scum", "worthless", "moron"]
    auto = toxicity.Automaton(dict.fromkeys(entries, False))
    rng = np.random.default_rng(4)
    words = ["idoit", "idi0t", "scums", "wrthles", "moron", "mooron", "x", "", "wortlhess"] + ["".join(rng.choice(list("idotscumwrhlen"), rng.integers(1, 9))) for _ in range(300)]
    for w in words:
        want = min(((distance(w, e), e) for e in entries if distance(w, e) <= toxicity.edits_allowed(e)), default=None)
        assert auto.match(w) == want, w
    begins = toxicity.Automaton({"vequ": True})
    assert begins.match("vequaire") == (0, "vequ") and begins.match("veau") is None


def labelled(spark, n=400):
    plain = ["the weather is fine today and people walk in the park number {}", "a report about trade and numbers with item {} inside", "some notes on cooking rice and beans number {}"]
    toxic = ["you are an idiot and a moron number {}", "what an idiot this person {} is", "shut up you moron number {}"]
    data = [(i, (toxic if i % 8 == 0 else plain)[i % 3].format(f"{i} {i * 7} {i * 13}"), "en", "s", 1) for i in range(n)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(n)]
    return spark.createDataFrame(data, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_misspellings_and_quotes(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema)))
    assert {"idiot", "moron"} <= set(model.lexicon)
    match = toxicity.Matcher(model.lexicon)
    score = lambda t: model.score(match(t))
    assert score("you idiot") >= 0.5 and score("you idoit and mor0n") >= 0.5 and score("nice park") < 0.5 and score(None) == score("") < 0.5
    assert match('he said "idiot" to them') == Counter({("idiot", False, True): 1})
    assert score('they quoted the word "idiot"') < score("idiot")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "you idiot"), (3, "fine " * 20000 + "idiot moron"), (3, "fine")], "doc_id bigint, text string").withColumns({"held_out": F.lit(False), "score": F.lit("x"), "label": F.lit(1)})
    got = toxicity.scores(odd, model).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1, 0]
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == 3
    empty = toxicity.fit(docs, labels.limit(0))
    assert empty.lexicon == {} and toxicity.scores(odd, empty).where("predicted = 1").count() == 0
    assert toxicity.scores(odd.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a> Site</header><nav><ul><li><a href="/a">A</a><li><a href='/b'>B</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Title &eacute;</h1><p>First   paragraph<br>goes on &amp; on with enough words to be one.<p>Second <b>bold</b> <i>text</i>&nbsp;here, with a <a href="#">link</a> in it.
<div class="ad">Buy now</div><blockquote>A quotation that stands alone.</blockquote></article>
<aside>Related: <a href=x>other</a></aside><form><label>Mail</label><input></form><section class="comments"><p>I disagree with this article entirely.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_html_main_text():
    assert html_cut.main_text(PAGE) == "Title é\nFirst paragraph goes on & on with enough words to be one.\nSecond bold text here, with a link in it.\nA quotation that stands alone."
    assert html_cut.main_text(None) == html_cut.main_text("") == html_cut.main_text("<p></p><!-- x") == ""
    assert html_cut.main_text("<article><p>open paragraph with many plain words") == "open paragraph with many plain words"
    deep = "<div>" * 3000 + "<p>" + "word " * 50 + "</p>"
    assert html_cut.main_text(deep).startswith("word")
    assert html_cut.main_text("<p " + 'a="' * 2000) is not None


def test_html_deep_elements_and_formulas():
    words = "plain words of an article that goes on for a while, " * 4
    tower = "<article>" + "<blockquote>" * 600 + f"<p>{words}</p><nav>Home and other places of this site</nav><template>{words}</template><select><option>One of many</select>"
    assert html_cut.main_text(tower) == words.strip()
    # The end tags of the deep elements close those, not the earlier ones.
    found = html_cut.blocks("<nav>" + "<span>" * 600 + "<nav>deep</nav>still in the outer one</nav><p>out</p>")
    assert [(b.text, "in:nav" in b.element.marks) for b in found] == [("deep", True), ("still in the outer one", True), ("out", False)]
    text = html_cut.main_text("<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> stands in the middle of this sentence.</p></article>")
    assert text == "The formula x=2 stands in the middle of this sentence."


def test_html_cut_turns_blocks_that_the_classifier_misses():
    """Blocks whose sign of the score is wrong and whose label is right, in both directions."""
    long = "plain words of a text that goes on for a while and does not say much about anything, "
    page = f"<div><p>{long * 3}</p><div>Short remark.</div><p>{long * 2}</p></div>"
    assert [(x > 0, y) for _, x, y in html_cut.labelled_blocks(page)] == [(True, True), (False, True), (True, True)]
    links = "".join(f"<p><a href=/{k}>Another page {k}</a></p>" for k in range(3))
    page = f"<div>{links}<p>More of it</p>{links}</div>"
    got = html_cut.labelled_blocks(page)
    assert got[3][1] > 0 and not any(y for _, _, y in got)


def test_html_words_do_not_veto_inside_articles():
    long = "plain words of an article that goes on for a while, " * 3
    for name in ("side-by-side", "legal", "share tags", "copyright"):
        assert html_cut.main_text(f'<article><div class="{name}"><p>{long}</p></div></article>') == long.strip()
    for name in ("ad", "comments", "newsletter-signup", "sidebar"):
        assert html_cut.main_text(f'<article><p>{long}</p><div class="{name}"><p>{long} of others</p></div></article>') == long.strip()
    assert html_cut.main_text(f'<article><p>{long}</p></article><div class=comments><article class=comment-body><p>{long} of others</p></article></div>') == long.strip()


def test_html_classifier_is_fitted(spark, sf):
    """Weights move from the prior towards known texts, and a feature that the prior does not know is learned."""
    text = [f"line {k} of the text number {k * 7} with some words of its own" for k in range(40)]
    page = lambda k: f"<div class=zone><p>{text[k]} and a good deal more of it</p></div><div class=fluff><p>{text[(k + 9) % 40]}</p></div>"
    pages = spark.createDataFrame([(k, "u", page(k)) for k in range(40)] + [(None, "u", page(1)), (99, "u", None)], "page_id bigint, url string, html string")
    known = spark.createDataFrame([(k, f"{text[k]} and a good  deal more of it\nanother line") for k in range(40)] + [(None, "x"), (77, None)], "doc_id bigint, text string")
    weights = html_cut.fit(pages, known)
    assert weights["word:fluff"] < weights["word:zone"]
    assert html_cut.fit(pages, known.limit(0)) == {} and html_cut.fit(pages.limit(0), known) == {}
    # Fitted on a part of the pages, it finds the texts of the others.
    docs, all_pages = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_cut.fit(all_pages.where("page_id % 2 = 0"), docs)
    texts = {" ".join((r.text or "").split()) for r in docs.collect()}
    found = [" ".join(r.text.split("\n", 1)[-1].split()) in texts for r in html_cut.extract(all_pages.where("page_id % 2 = 1"), weights).collect()]
    assert np.mean(found) > 0.98


def test_regression_finds_the_stationary_point():
    rows = [(["bias", "word:x"], 1, 30), (["bias", "word:x"], 0, 10), (["bias"], 1, 5), (["bias"], 0, 40)]
    w = html_cut.regress(rows, spread=1.0)
    cost = lambda b, x: sum(n * np.log1p(np.exp(-(b + ("word:x" in f) * x) * (1 if y else -1))) for f, y, n in rows) + ((b + 0.5) ** 2 + x**2) / 2
    best = cost(w["bias"], w["word:x"])
    assert all(best <= cost(w["bias"] + d, w["word:x"] + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_min_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        content, boiler = rng.random(n).tolist(), rng.random(n).tolist()
        edges = {(i, j): float(rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}
        cost = lambda lab: sum(c if x else b for x, c, b in zip(lab, content, boiler, strict=True)) + sum(w for (i, j), w in edges.items() if lab[i] != lab[j])  # noqa: B023, E731
        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert cost(html_cut.min_cut(content, boiler, edges)) == pytest.approx(best)


def test_html_table(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = html_cut.extract(pages).collect()
    assert [r.n_chars for r in got][2] == 0 and got[0] == got[1] and got[0].n_chars == len(got[0].text)
    assert html_cut.extract(pages.limit(0)).count() == 0
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = [" ".join(r.text.split("\n", 1)[-1].split()) in texts for r in html_cut.op5_html_cut(spark, sf).collect()]
    assert np.mean(found) > 0.9  # below its headline a page holds a document


def test_warc_round_trip(spark):
    data = [(5, "http://a/é b", "<p>x</p>"), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (9, None, None), (2, "e", ""), (None, "n", "only"), (7, "z\r\nX: y", "ünï" * 50_000), (11, "http://x/a%20b?q=%2F#'", "q"), (12, "http://x/a%20b ü", "r"), (13, "", "s")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumns({"size": F.lit("s"), "sha1": F.lit(1)})
    manifest = warc_zip.write_archives(pages, shared_dir(spark) + "/warc-test", records=2)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in warc_zip.read_archives(manifest).collect()), key=str)
    size = lambda t: len((t or "").encode())
    want = []
    for p, u, h in data:
        first = {"<p>x</p>": 3, "": 2, None: 2}.get(h, p)
        want.append((p, size(h), "response" if p == first else "revisit", None if p == first else first, u))
    assert got == sorted(want, key=str)
    digests = {r.page_id: r.payload_digest for r in warc_zip.read_archives(manifest).collect()}
    assert digests[3] == digests[5] == warc_zip.payload_digest(b"<p>x</p>")
    large = warc_zip.write_archives(pages, shared_dir(spark) + "/warc-test2", min_bytes=5)
    assert {r.page_id: r.record_type for r in warc_zip.read_archives(large).collect()}[9] == "response"
    assert warc_zip.read_archives(warc_zip.write_archives(pages.limit(0), shared_dir(spark) + "/warc-test3")).count() == 0


def test_zip64_directory(tmp_path):
    """A directory whose sizes and offsets stand in ZIP64 fields only."""
    name, data = b"archive/data.warc", b"0123456789"
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 10, 10) + data
    extra = struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    central = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "a.zip"
    path.write_bytes(local + central + end64 + locator + end)
    assert zipfile.ZipFile(path).read(name.decode()) == data
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        z = warc_zip.ZipDirectory(f, f.size())
        at, n = z.locate(name.decode())
        assert z.read(at + 2, 3) == b"234" and n == 10
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as w:
        w.writestr("x", "y" * 100)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "c.zip")) as f, pytest.raises(ValueError):
        warc_zip.ZipDirectory(f, f.size()).locate("x")


ODD_TEXTS = [None, "", " \n", "It's I'LL don't, U.S.A., 3.14 x,y ,, ... école Ünï İstanbul Σσς ﬁne ①² 中文字，好 \x1cab a\xa0b", "<|endoftext|> a<|ENDOFTEXT|>b", "_a_, 's. 'S ’s don’t", "w. w, w.w %%%a%%% A.B,c", "é" * 3000 + " tail"]


def test_encoder_equals_the_library(spark, sf):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD_TEXTS
    for most in (10, 600_000):
        got = token_files.Encoder(path, most)(texts, 2)
        assert got == [np.array(e.ids + [2], "<i4").tobytes() for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark, tmp_path):
    rows = [(i * 3, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "again"), (None, "no id")] + [(100 + i, f"text number {i} " * 50) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"part": F.lit("x"), "ids": F.lit(1)}).repartition(5)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for encoding in ("delta", "dictionary"):
        path = f"file://{tmp_path}/{encoding}"
        token_files.write_tokens(docs, path, encoding=encoding, page_rows=20)
        got = [tuple(r) for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        import pyarrow.parquet as pq

        files = [pq.ParquetFile(f) for f in (tmp_path / encoding).glob("*.parquet")]
        column = next(c for f in files if f.metadata.num_rows for c in [f.metadata.row_group(0).column(4)])
        assert column.path_in_schema.startswith("ids") and column.has_offset_index
        assert any("DICTIONARY" in e if encoding == "dictionary" else "DELTA" in e for e in column.encodings)
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(docs.limit(0), empty)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]
    one = corpus_pipeline.STAGES[1][1](spark, docs, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {d for d, (c, _) in H.near_duplicates(texts).items() if c == d}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    clean = corpus_pipeline.STAGES[2][1](spark, one, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, x in H.contamination({d: texts[d] for d in want}, items).items() if x[1]}
    assert {r.doc_id for r in clean.collect()} == want - leaks and clean.columns == docs.columns
    mixed = corpus_pipeline.STAGES[3][1](spark, clean, sf)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == want - leaks and mixed.columns == docs.columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, sf)
    assert last.count() == mixed.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "other text without an id", None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 9000, None, None, 1)], DOCS)
    got = [stage(spark, odd, sf).select("doc_id").collect() for _, stage in corpus_pipeline.STAGES]
    assert [len(x) for x in got] == [5, 4, 5, len(got[3]), 5]
    assert {r.doc_id for r in got[3]} == {None, 1, 2} and len(got[3]) >= 5


def test_pipeline_keeps_clashing_columns(spark, sf):
    """Extra columns with the names that stages use come through, and rows that repeat a doc_id with another text are not lost."""
    names = ["copies", "_copy", "n_hit", "n_words", "_words", "_key", "_doc", "doc", "held", "held_out", "text_key", "is_first", "class_id", "n_tokens", "block", "weight", "rank", "set_id", "key"]
    one, two = "the first text of this id stands here for a while", "an altogether different second text that has no word like it"
    data = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (1, two, "fr", "a", 1), (2, one, "en", "b", 1), (3, two + " again", "en", "b", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(data, DOCS).withColumns({c: F.lit(f"<{c}>") for c in names})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == f"<{c}>" for r in kept for c in names)
        if stage is corpus_pipeline.one_of_each_group:
            assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, two), (1, one), (4, "")]  # 3 is a near copy
        else:
            assert {(r.doc_id, r.text) for r in kept} == {(d, t) for d, t, *_ in data}
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() == 6
