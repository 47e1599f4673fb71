"""Alignment of two tokenizers, against a plain walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaza.llm import token_align as TA

SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in SHOWN} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}


@pytest.fixture(scope="module")
def plain():
    """A function from texts to the rows of the contract."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a, of_b = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a], [bytes_b(i) for i in ids_b]
        want = (" " + text).encode()
        if b"".join(of_a) != want or b"".join(of_b) != want:
            return []
        ends_b, out, at_a, at_b, j = set(np.cumsum([len(x) for x in of_b]).tolist()), [], 0, 0, 0
        total_b = np.cumsum([len(x) for x in of_b]).tolist()
        end = 0
        for i, x in enumerate(of_a):
            end += len(x)
            if end in ends_b:
                j = total_b.index(end, at_b) + 1
                out.append((ids_a[at_a : i + 1], ids_b[at_b:j]))
                at_a, at_b = i + 1, j
        return out

    def rows(texts):
        found = [groups(t) for t in texts]
        pairs = [Counter((x, y) for p, q in g for x in p for y in q) for g in found]
        count = Counter(k for p in pairs for k in p)
        best = {}
        for (x, _), n in count.items():
            best[x] = max(best.get(x, 0), n)
        out = []
        for g, p in zip(found, pairs, strict=True):
            told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(p.values()), sum(n for k, n in p.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in p.items()), hashlib.sha256(told.encode()).hexdigest() if g else ""))
        return out

    return rows


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    aligned = TA.align(docs, **options)
    frequent = options.get("steps", 1_000_000)
    sums = TA.with_counts(aligned, TA.pair_counts(aligned), frequent)
    out = aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("sha256").alias("groups_sha256"))
    return [tuple(r[c] for c in NAMES) for r in out.orderBy("doc_id").collect()]


ODD = [
    None, "", " ", "a", "  two  spaces\n\n\ttabs ", "<|endoftext|> and <s> and <0x41> </s>", "U+2581 ▁ here", "naïve café £5 — “quoted”", "日本語のテキスト 🙂🙃 emoji", "\u0000nul", "x" * 3000, " " * 2500, "ab " * 900,
    "=" * 777 + "-" * 555, "aaaaaaaaaab" * 300, "Zalgo é́́", "same text", "same text", "don't won't 'll I'd " * 40, "\r\n\r\n" * 50, "1234567890" * 30, "   odd spaces 　",
]


def test_rows_equal_the_plain_walk(spark, plain):
    assert result(spark, ODD) == plain(ODD)


def test_small_pieces_and_parts_give_the_same(spark, plain):
    long = [" ".join(f"word{i % 7} unbelievable {i}" for i in range(400)), ("no seams here: " + "x1" * 500), "bad ▁ " + "many words of a long text " * 60]
    want = plain([*ODD, *long])
    for steps, part in ((16, 40), (7, 1 << 16), (64, 200)):
        assert result(spark, [*ODD, *long], steps=steps, part=part) == want


def test_whole_documents(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in TA.op11_token_align(spark, sf).collect()}
    assert [got[d.doc_id] for d in docs] == plain([d.text for d in docs])


def test_groups_can_be_kept(spark):
    docs = spark.createDataFrame([(1, "hello tokenizers", "x"), (None, "again", "y")], "doc_id bigint, text string, pairs string")
    rows = TA.align(docs, keep_groups=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.sha256 for r in rows) and {r.doc_id for r in rows} == {1, None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    aligned = TA.align(docs)
    assert aligned.count() == 0 and TA.with_counts(aligned, TA.pair_counts(aligned)).count() == 0


@given(st.lists(st.integers(1, 9), min_size=1, max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=60), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_are_of_equal_work_and_keep_equal_ends_together(a, b, steps):
    a, b = np.cumsum(a), np.cumsum(b)
    cut = TA.pieces(a, b, steps)
    assert [i for i, *_ in cut[1:]] == [k for _, k, *_ in cut[:-1]] and [j for _, _, j, _ in cut[1:]] == [m for *_, m in cut[:-1]]
    assert cut[0][0] == cut[0][2] == 0 and cut[-1][1] == len(a) and cut[-1][3] == len(b)
    assert all(abs((k - i) + (m - j) - steps) <= 1 for i, k, j, m in cut[:-1])
    for i, k, j, m in cut:
        inside, other_a, other_b = set(a[i:k]), set(a) - set(a[i:k]), set(b) - set(b[j:m])
        assert not (inside & other_b) and not (set(b[j:m]) & other_a)
