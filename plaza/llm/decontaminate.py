"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

Every benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one window). A window is
the set of its shingles with their positions, and a document contains it exactly if some shingle of the document starts
an equal run of words. The join follows the prefix-filter principle: shingles are ordered by rarity over the whole
corpus, and as containment must be full, the necessary prefix is the one rarest shingle of the window. A document that
lacks it cannot contain the window. A candidate passes the positional and length bounds (the window must start at or
after the first word and end within the text) and is then verified word by word.

Texts are parsed once (``scan``): of all positions of a text only those stay whose shingle stands in the benchmark, each
with the words around it that a window through it can have, and one row that carries the number of words. Rarity, the
join by the prefix and the check all work on this small table.

The scan holds the benchmark's shingle hashes as a broadcast table of ``keys_per_scan`` numbers of 8 bytes at most; a benchmark
with more is scanned for in that many blocks, each against all texts. No other side is broadcast by hint.

Cases: a null or empty text has no words, so it is never contaminated and a null item has no windows; repeated documents
are judged alike and each row is returned; repeated items with one id count once; an empty benchmark contaminates
nothing; very long texts are exploded to one row a word, so no task holds more than it reads; other columns stay as they are, and
those of ``contamination``'s own names (n_words, n_hit, item_ids) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plaza.llm.shared import staged

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOCUMENT = 0  # the key of the row that a document has for itself


def words_of(text: Column) -> Column:
    """The words of a text, with A to Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def item_windows(items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """(item_id, length, words, size, shingles) of each window of ``items`` (item_id, text).

    ``shingles`` are (at, key); ``size`` is the words in a shingle, fewer for short windows.
    """
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.lit(window), F.size("w")))
    w = w.select("item_id", "length", F.explode(F.expr("transform(sequence(0, size(w) - length), i -> slice(w, i + 1, length))")).alias("words")).distinct()
    w = w.withColumn("size", F.least(F.lit(shingle), F.col("length")))
    # The key of a shingle hashes its words one after another, and the number of them tells shorter ones apart.
    keys = [f"WHEN {k} THEN xxhash64({', '.join(f'words[i + {j}]' for j in range(k))})" for k in range(1, shingle + 1)]
    return w.withColumn("shingles", F.expr(f"transform(sequence(0, length - size), i -> struct(i as at, CASE size {' '.join(keys)} END as key))"))


def scan(docs: DataFrame, keys: DataFrame, sizes: list[int], window: int, n_keys: int, keys_per_scan: int = 4_000_000) -> DataFrame:
    """(doc, n_words, size, pos, key, first, near) of ``docs`` (doc, words): the shingles of ``sizes`` words whose key is in ``keys`` (key).

    ``near`` are the words from place ``first`` on that a window through the shingle can have. A row with pos = n_words and
    without a key stands for the document itself.
    """
    blocks, out = max(1, -(-n_keys // keys_per_scan)), []
    n, pos = F.col("n_words"), F.col("pos")
    at = docs.withColumn("n_words", F.size("words")).select("*", F.explode(F.sequence(F.lit(0), n)).alias("pos"))
    for block in range(blocks):
        known = keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        for size in sizes:
            hashed = F.when(pos <= n - size, F.xxhash64(*[F.col("words")[pos + j] for j in range(size)]))
            if not out:  # one of the scans has a row for each document
                hashed = hashed.when(pos == n, F.lit(_DOCUMENT))
                known = known.union(keys.sparkSession.range(1).select(F.lit(_DOCUMENT).alias("key"))).distinct()
            found = at.withColumn("key", hashed).join(F.broadcast(known), "key", "left_semi")
            whole, first = pos == n, F.greatest(pos - (window - size), F.lit(0))
            near = F.when(~whole, F.slice("words", first + 1, F.lit(2 * window - size)))
            out.append(found.select("doc", "n_words", F.lit(size).alias("size"), "pos", F.when(~whole, F.col("key")).alias("key"), first.alias("first"), near.alias("near")))
    return reduce(DataFrame.unionByName, out)


def find_windows(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, keys_per_scan: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, n_words) of ``docs`` (doc, words), and all occurrences (doc, item_id, start, length) of item windows in them."""
    windows = staged(item_windows(items, window, shingle), "windows")
    flat = windows.select(F.monotonically_increasing_id().alias("window_id"), "*")
    flat = staged(flat.select("window_id", "item_id", F.col("words").alias("item_words"), "length", "size", F.explode("shingles").alias("x")).select("*", "x.at", "x.key").drop("x"), "shingles")
    keys = flat.select("key").distinct()
    sizes = sorted((r[0] for r in flat.select("size").distinct().collect()), reverse=True) or [shingle]  # at most ``shingle`` values
    scanned = staged(scan(docs, keys, sizes, window, keys.count(), keys_per_scan), "scanned")
    hits = scanned.where("key is not null")
    # Rarity: how often each shingle of the benchmark occurs in the whole corpus.
    rarity = hits.groupBy("key", "size").agg(F.count("*").alias("rarity"))
    ordered = Window.partitionBy("window_id").orderBy("rarity", "key", "at")
    prefix = flat.join(rarity, ["key", "size"], "left").withColumn("rarity", F.coalesce("rarity", F.lit(0)))
    # A window with a shingle that never occurs cannot occur either.
    prefix = staged(prefix.withColumn("rank", F.row_number().over(ordered)).where("rank = 1 and rarity > 0").select("key", "size", "item_id", "item_words", "length", "at"), "prefix")
    near = hits.join(prefix, ["key", "size"]).withColumn("start", F.col("pos") - F.col("at")).where("start >= 0 and start + length <= n_words")
    found = near.where(F.expr("slice(near, start - first + 1, length) = item_words")).select("doc", "item_id", "start", "length")
    return scanned.where("key is null").select("doc", "n_words"), found.distinct()


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, n_words) of ``docs`` (doc, text), and (doc, n_hit, item_ids) of those that hold a window of ``items``."""
    rows, found = find_windows(docs.select("doc", words_of(F.col("text")).alias("words")), items, window)
    found = staged(found, "found")
    spans = found.select("doc", "start", "length").distinct()
    hit = spans.select("doc", F.explode(F.expr("sequence(start, start + length - 1)")).alias("p")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    named = found.select("doc", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return rows, hit.join(named, "doc")


def row_key(doc_id: Column, text: Column) -> Column:
    """What rows have in common that are judged alike: the id and the text."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text and any more columns), with n_words, n_hit and the sorted item_ids added."""
    plain = docs.drop("n_words", "n_hit", "item_ids")
    held = plain.select(F.struct(*[plain[c] for c in plain.columns]).alias("held"))
    doc = row_key(F.col("held.doc_id"), F.col("held.text"))
    rows, result = contaminated(held.select(doc.alias("doc"), F.col("held.text").alias("text")), items, window)
    result = rows.distinct().join(result, "doc", "left")
    out = held.withColumn("doc", doc).join(result, "doc")
    n_hit, item_ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("held.*", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), item_ids.alias("item_ids"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any more columns), with all their columns, that hold no window of ``items``."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("held"))
    doc = row_key(F.col("held.doc_id"), F.col("held.text"))
    _, result = contaminated(held.select(doc.alias("doc"), F.col("held.text").alias("text")), items, window)
    return held.withColumn("doc", doc).join(result, "doc", "left_anti").select("held.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(row_key(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    rows, result = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    out = rows.join(result, "doc", "left")
    ids, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc.doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p + 1:p + least(10, len(w))], ' ') AS s, least(10, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p + 1:p + n], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {"op2_decontamination": OP2_SQL}
