"""License scans by a positional index of rare words, in DataFrame operations only.

A template is the opening or the notice of a license, with key phrases that are mandatory. The index holds, for each phrase, its words of
the highest inverse document frequency with their places in the phrase. The frequencies are those of the whole corpus, counted for all words of the
templates. A scan looks up the indexed words of each file; a posting at place ``p`` of a word that is number ``q`` of a phrase says that the phrase
would begin at ``p - q``, and a beginning on which all indexed words of the phrase agree is a candidate. A candidate is verified word by word.
A template is found where all of its phrases stand at their places relative to each other, give or take ``slack`` words, and at least ``least`` of its distinct
words stand in its window; that share is its score. As a phrase is looked up by its own rarest words, no file that has it is missed, however many licenses a file has.

Texts are parsed once for the frequencies and once for the scan; of all positions only those stay that hold an indexed word, with the words
around them. Templates and their index are a parameter of the job, so they are literals of the plan; nothing else is broadcast by hint.

Cases: a null or empty text has no words, no labels and score 0; every row is returned, repeated ones too; a null doc_id is kept; many copies of a license
in one file are all found; an empty table gives an empty result; very long texts are exploded to one row a word; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm.decontaminate import _WORDS_SQL, GAP, LOWER, UPPER, words_of
from plaza.llm.shared import staged

# The base phrases of the contract, each with its label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Openings and notices of public licenses. Label, text, key phrases.
TEMPLATES = [
    ("mit", "under the MIT License", ["the MIT License"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["Permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "Apache License, Version 2", ["Apache License Version 2"]),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["except in compliance with the License", "apache org licenses LICENSE 2 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["Redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["Neither the name of", "to endorse or promote products derived from this software"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["Permission to use copy modify and or distribute this software for any purpose with or without fee"]),
    ("gpl-2", "GNU General Public License, version 2", ["GNU General Public License version 2"]),
    ("gpl-3", "GNU General Public License, version 3", ["GNU General Public License version 3"]),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation", ["under the terms of the GNU General Public License"]),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["GNU Lesser General Public License"]),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ["GNU Affero General Public License"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["Mozilla Public License v 2 0"]),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ["Eclipse Public License 2 0"]),
    ("bsl-1", "Distributed under the Boost Software License, Version 1.0", ["Boost Software License Version 1 0"]),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ["provided as is without any express or implied warranty", "in no event will the authors be held liable"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ["Creative Commons Attribution 4 0 International"]),
    ("cc-by", "licensed under CC BY 4.0", ["CC BY 4 0"]),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["Creative Commons Attribution ShareAlike"]),
    ("cc-by-sa", "licensed under CC BY-SA 4.0", ["CC BY SA"]),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["Creative Commons Attribution NonCommercial"]),
    ("cc-by-nc", "CC BY-NC", ["CC BY NC"]),
]


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the template, words

    @classmethod
    def of(cls, number: int, label: str, text: str, keys: list[str]) -> Template:
        """Raises ValueError if a key phrase does not stand in the text."""
        words, phrases = plain_words(text), []
        for key in keys:
            k = plain_words(key)
            at = next((i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k), None)
            if at is None:
                raise ValueError(f"{key!r} is not in the template {label}")
            phrases.append((at, tuple(k)))
        return cls(number, label, tuple(words), tuple(phrases))


def _values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    """A table of literals, whose size the planner knows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _text(w: str) -> str:
    return "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: tuple[str, ...]) -> str:
    return f"array({', '.join(map(_text, words))})"


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of ``docs`` (text) each word of the templates stands: a number for each word of the vocabulary."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), known)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["n"] for r in found.collect()}


def rare_words(phrase: tuple[str, ...], frequency: dict[str, int], most: int) -> list[tuple[int, str]]:
    """The first places of the ``most`` distinct words of a phrase with the highest inverse document frequency."""
    return [(phrase.index(w), w) for w in sorted(set(phrase), key=lambda w: (frequency[w], w))[:most]]


def _base_label(words: Column, pos: Column, base: dict[str, str]) -> Column:
    """The label of the base phrase that begins at ``pos``, if any; ``get`` is null beyond the end."""
    out = F.lit(None).cast("string")
    for phrase, label in base.items():
        here = F.lit(True)
        for k, w in enumerate(plain_words(phrase)):
            here = here & (F.get(words, pos + k) == w)
        out = F.when(here, F.lit(label)).otherwise(out)
    return out


def scan(docs: DataFrame, index: list[str], base: dict[str, str], around: int) -> DataFrame:
    """(row, doc_id, n_words, pos, word, base, first, near): the places of indexed words and base phrases of ``docs`` (doc_id, text).

    ``near`` are the words from place ``first`` on, ``around`` before and after. The row with pos = n_words stands for the document.
    """
    n, pos = F.col("n_words"), F.col("pos")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), n)).alias("pos")).withColumn("word", F.get("words", pos))
    heads = sorted({plain_words(p)[0] for p in base})
    found = at.where((pos == n) | F.col("word").isin(sorted({*index, *heads})))
    label = F.when(F.col("word").isin(heads), _base_label(F.col("words"), pos, base))
    indexed, first = F.col("word").isin(index), F.greatest(pos - around, F.lit(0))
    out = found.select("row", "doc_id", "n_words", "pos", "word", label.alias("base"), first.alias("first"), F.when(indexed, F.slice("words", first + 1, 2 * around + 1)).alias("near"))
    return out.where("word is null or base is not null or near is not null")


def find_templates(scanned: DataFrame, templates: list[Template], index: dict[tuple[str, ...], list[tuple[int, str]]], slack: int, least: float) -> DataFrame:
    """(row, label, start, score) of the templates in what ``scan`` has found."""
    spark = scanned.sparkSession
    if not templates:
        return scanned.where("false").select("row", F.lit("").alias("label"), F.col("pos").alias("start"), F.lit(0.0).alias("score"))
    phrases = list(index)
    postings = _values(spark, [f"({_text(w)}, {k}, {at}, {len(index[p])})" for k, p in enumerate(phrases) for at, w in index[p]], "word, phrase, at, n_rare")
    hits = scanned.where("near is not null").select("row", "pos", "word", "first", "near").join(postings, "word").withColumn("start", F.col("pos") - F.col("at")).where("start >= 0")
    agreed = hits.groupBy("row", "phrase", "start").agg(F.count_distinct("word").alias("n"), F.max("n_rare").alias("n_rare"), F.min_by(F.struct("first", "near"), "pos").alias("x"))
    agreed = agreed.where("n = n_rare").select("row", "phrase", "start", "x.first", "x.near")
    texts = _values(spark, [f"({k}, {_array(p)})" for k, p in enumerate(phrases)], "phrase, phrase_words")
    verified = agreed.join(texts, "phrase").where(F.expr("slice(near, start - first + 1, size(phrase_words)) = phrase_words")).drop("phrase_words")
    # Phrases of a template meet in buckets of its beginning, each of at most ``slack`` + 1 beginnings of each phrase.
    uses = _values(spark, [f"({phrases.index(p)}, {t.number}, {at}, {k})" for t in templates for k, (at, p) in enumerate(t.phrases)], "phrase, template, place, part")
    placed = staged(verified.join(uses, "phrase").withColumn("begin", F.col("start") - F.col("place")).withColumn("bucket", F.floor(F.col("begin") / (slack + 1))), "placed")
    lead = placed.where("part = 0").select("row", "template", "begin", "bucket", "first", "near")
    others = placed.where("part > 0").select("row", "template", "part", F.col("begin").alias("other"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    together = lead.join(others, ["row", "template", "bucket"], "left").where(F.col("other").isNull() | (F.abs(F.col("other") - F.col("begin")) <= slack))
    whole = together.groupBy("row", "template", "begin").agg(F.count_distinct("part").alias("n_parts"), F.min_by(F.struct("first", "near"), "first").alias("x"))
    facts = _values(spark, [f"({t.number}, {_text(t.label)}, {len(t.phrases) - 1}, {len(t.words)}, {_array(tuple(dict.fromkeys(t.words)))})" for t in templates], "template, label, more, length, words")
    whole = whole.join(facts, "template").where("n_parts = more")
    low = F.greatest(F.col("begin") - slack, F.col("x.first"))
    window = F.slice("x.near", (low - F.col("x.first") + 1).cast("int"), (F.col("begin") + F.col("length") + slack - low).cast("int"))
    score = F.size(F.array_intersect("words", window)) / F.size("words")
    return whole.select("row", "label", F.col("begin").alias("start"), score.alias("score")).where(F.col("score") >= least)


def licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: dict[str, str] = BASE, rare: int = 2, slack: int = 4, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What ``scan`` finds in ``docs`` (doc_id, text), with a row for each document, and the templates in it (row, label, start, score)."""
    known = [Template.of(k, *t) for k, t in enumerate(templates)]
    phrases = sorted({p for t in known for _, p in t.phrases})
    frequency = document_frequency(docs, sorted({w for p in phrases for w in p}))
    # A phrase with a word that no text has stands nowhere, and neither does its template.
    known = [t for t in known if all(frequency[w] for _, p in t.phrases for w in p)]
    index = {p: rare_words(p, frequency, rare) for p in phrases if any(p == q for t in known for _, q in t.phrases)}
    around = max((len(t.words) for t in known), default=0) + max((len(p) for p in index), default=0) + slack
    scanned = staged(scan(docs.select("doc_id", "text"), sorted({w for ws in index.values() for _, w in ws}), base, around), "scanned")
    return scanned, find_templates(scanned, known, index, slack, least)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, found = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places = scanned.where("base is not null").groupBy("row").agg(F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"), F.collect_set("base").alias("base_labels"))
    own = found.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("score").alias("score"))  # sets of at most all labels
    none = F.array().cast("array<string>")
    of_base, of_all = F.coalesce("base_labels", none), F.array_union(F.coalesce("base_labels", none), F.coalesce("own", none))
    return scanned.where("word is null").select("row", "doc_id", "n_words").join(places, "row", "left").join(own, "row", "left").select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(of_base), ",").alias("base_labels"), F.array_join(F.array_sort(of_all), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    known = [Template.of(k, *t) for k, t in enumerate(TEMPLATES)]
    array = lambda words: f"[{', '.join(map(_text, words))}]"
    base = " ".join(f"WHEN w[p + 1:p + {len(ws)}] = {array(ws)} THEN '{label}'" for ws, label in ((plain_words(x), y) for x, y in BASE.items()))
    parts = ", ".join(f"({t.number}, {k}, {at}, {array(p)})" for t in known for k, (at, p) in enumerate(t.phrases))
    facts = ", ".join(f"({t.number}, '{t.label}', {len(t.phrases) - 1}, {len(t.words)}, {array(dict.fromkeys(t.words))})" for t in known)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
parts AS (SELECT * FROM (VALUES {parts}) v(template, part, place, pw)),
facts AS (SELECT * FROM (VALUES {facts}) v(template, label, more, length, tw)),
pos AS (SELECT r, w, unnest(range(0, len(w))) AS p FROM d),
based AS (SELECT r, p, CASE {base} END AS label FROM pos),
b AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM based WHERE label IS NOT NULL GROUP BY r),
heads AS (SELECT pos.r, pos.w, pos.p, parts.* FROM pos JOIN parts ON pos.w[pos.p + 1] = parts.pw[1]),
hits AS (SELECT r, template, part, p - place AS t0 FROM heads WHERE w[p + 1:p + len(pw)] = pw),
whole AS (SELECT l.r, l.template, l.t0 FROM (SELECT * FROM hits WHERE part = 0) l JOIN facts USING (template)
          WHERE (SELECT count(DISTINCT o.part) FROM hits o WHERE o.part > 0 AND o.r = l.r AND o.template = l.template AND abs(o.t0 - l.t0) <= 4) = more),
scored AS (SELECT whole.r, label, len(list_intersect(tw, w[greatest(t0 - 4, 0) + 1:t0 + length + 4])) / len(tw) AS score FROM whole JOIN facts USING (template) JOIN d ON d.r = whole.r),
labelled AS (SELECT r, label FROM scored WHERE score >= 0.5 UNION SELECT r, label FROM based WHERE label IS NOT NULL),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM labelled GROUP BY r),
s AS (SELECT r, max(score) AS score FROM scored WHERE score >= 0.5 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""


QUERIES = {"op12_license_scan": op12_license_scan}
ORACLES = {"op12_license_scan": _sql()}
