"""License scans against a plain search."""

import pytest

from plaza.llm import license_scan as LS

KNOWN = [LS.Template.of(k, *t) for k, t in enumerate(LS.TEMPLATES)]


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == list(phrase)]


def plain(text, slack=4, least=0.5):
    w = LS.plain_words(text or "")
    base = sorted((i, label) for p, label in LS.BASE.items() for i in places(w, LS.plain_words(p)))
    own, score = set(), 0.0
    for t in KNOWN:
        begins = [[i - at for i in places(w, p)] for at, p in t.phrases]
        for b in begins[0]:
            if all(any(abs(o - b) <= slack for o in more) for more in begins[1:]):
                window = set(w[max(b - slack, 0) : b + len(t.words) + slack])
                share = len(set(t.words) & window) / len(set(t.words))
                if share >= least:
                    own.add(t.label)
                    score = max(score, share)
    labels = {x for _, x in base}
    return (len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | own)), score)


FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
MIT, BSD = LS.TEMPLATES[1][1], LS.TEMPLATES[4][1]
TEXTS = [
    None, "", "no license at all", "Released under the MIT License.", "under the mit under the MIT license license", "Licensed under the Apache License, Version 2.0", "CC BY-NC 4.0, CC-BY-NC and cc by nc",
    MIT, MIT.replace("this software", "this very fine software"), MIT.replace("free of charge", "for some money"), "prefix words " * 5 + BSD + " suffix " + MIT, "Permission is hereby granted, free of charge",
    "without restriction " + MIT[:60], "(c) 2020 someone.\n" + "\n".join([MIT, BSD] * 40), "under the terms of the GNU General Public License", "provided that the following conditions are met", "GNU General Public License, version 3. GNU General Public License, version 2.",
    "x " * 20000 + "under the MIT License", "UNDER\tTHE\nMIT...LICENSE", "l'under the mit licensé", "é under the mit license é", MIT.replace("to any person", "to any one two three four five six seven person"),
]


def test_equals_a_plain_search(spark, tmp_path):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[3], "again")] * 2
    spark.createDataFrame(rows, "doc_id bigint, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = LS.op12_license_scan(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, *map(str, (r[c] for c in FIELDS))) for r in got), key=key) == sorted(((d, *map(str, plain(t))) for d, t, _ in rows), key=key)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in LS.op12_license_scan(spark, sf).collect()}
    assert got == {d.doc_id: plain(d.text) for d in docs}
    assert any(v[5] for v in got.values())


def test_rare_words_are_the_rarest_of_the_corpus(spark):
    docs = spark.createDataFrame([("the mit",), ("the license",), ("the license license",)], "text string")
    n = LS.document_frequency(docs, ["license", "mit", "the"])
    assert n == {"license": 2, "mit": 1, "the": 3} and LS.rare_words(("the", "mit", "license"), n, 2) == [(1, "mit"), (2, "license")]


def test_empty_table_and_wrong_template(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert LS.op12_license_scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        LS.Template.of(0, "x", "some words", ["other"])
