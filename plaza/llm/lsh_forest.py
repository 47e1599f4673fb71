"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents are sets of shingles of five words (ASCII lower-cased runs of letters, digits and non-ASCII characters). Equal
sets are first collapsed to one set with an id. Then:

1. Forest. Each of ``trees`` prefix tries holds the sets sorted by ``depth`` MinHash values of their own. A prefix is
   shortened, from ``depth`` values down, for a set only until sets at the wanted similarity meet it with probability
   ``recall`` in at least one trie: ``1 - (1 - s**k)**trees``, where s is the least similarity that a set of its
   size can have with another one and still be linked (``shortest_prefixes``; a set of up to three shingles has no such
   partner at all). The forest is walked from long prefixes to short ones, and a node in which all sets belong to one
   group already is not walked any further.
2. Sketches. Candidates are verified before anything is grouped: a sketch of 512 bits (one bit of each of 512 MinHash
   values) tells the similarity to within 0.03, and pairs under ``similarity - slack`` are no links; the margin is six standard deviations.
   First every set meets the first set of each of its nodes; sets linked this way are one group already. Nodes
   that still hold several groups are walked as sorted tries (``_walk``): from the longest shared prefix
   to the shorter ones, and sets of different groups alone are compared.
3. Exact check. Groups of sketch-verified links are small; all pairs of a group are checked on the shingle sets. A group is cut
   into blocks of bounded size and each pair of blocks is one cell, whose intersections come from a few matrix products
   (frequent shingles) and pair counts (rare ones). A cell returns a row for each of its sets (number of links, root of
   its links), never the pairs, so results stay linear while no link is left out.

The result has a row for each row of the input: ``class_id`` (the smallest doc_id that it is linked to, over any number of
links), ``n_links`` (other documents at the wanted similarity or above, equal ones included), ``n_texts`` (such different
texts) and ``n_copies`` (documents of an equal set, itself included).

Cases: a null or empty text has no shingles, no links and a class of its own; a text of fewer than five words is one
shingle of them all; rows that repeat a doc_id with an equal text are one document, and each row is returned; rows that repeat a doc_id
with different texts are documents of their own, each with its own class and links; a null doc_id gets
no class and is no document to others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import textbytes as tb
from plaza.llm.graph import components
from plaza.llm.shared import slices, staged

SKETCH = 8  # numbers of 64 bits
_SKETCH = [f"s{i}" for i in range(SKETCH)]
_SIGNED = "doc_id bigint, text_key bigint, n bigint, set_a bigint, set_b bigint, nodes array<bigint>, tails array<bigint>, " + ", ".join(f"{c} bigint" for c in _SKETCH)
_EDGE = "a bigint, b bigint"
_CELL = "set_id bigint, linked_docs bigint, linked_texts bigint, root bigint"


def least_similarity(n: int, similarity: float) -> float:
    """The least Jaccard similarity of at least ``similarity`` that a set of n elements can have with a different set; 1 if there is none."""
    best = 1.0
    for size in range(int(n * similarity), int(n / similarity) + 2):
        for both in range(min(n, size) + 1):
            got = both / (n + size - both) if n + size > both else 1.0
            if similarity - 1e-9 <= got < best:
                best = got
    return best


def prefix_length(trees: int, depth: int, similarity: float, recall: float) -> int:
    """The longest prefix, at most ``depth``, with which the forest reaches ``recall`` at ``similarity``."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shortest_prefixes(trees: int, depth: int, similarity: float, recall: float, sizes: int = 64) -> np.ndarray:
    """For sets of n elements, the length down to which their prefixes are shortened; the last entry holds for all larger sets.

    ``depth + 1`` stands for sets that are linked to equal ones only.
    """
    found = [least_similarity(n, similarity) for n in range(sizes)]
    return np.array([*[depth + 1 if s == 1 else prefix_length(trees, depth, s, recall) for s in found], prefix_length(trees, depth, similarity, recall)])


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges [lo, hi) of ``texts``: the distinct shingle hashes, sorted within rows, and their rows from lo on."""
    data, offsets = tb.flat(texts)
    for lo, hi in tb.chunks(offsets, 1 << 20):
        words, rows = tb.hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h, r = tb.shingle_hashes(words, rows, hi - lo, size)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[new], r[new]
        yield lo, hi, h, r


def _signer(size: int, trees: int, depth: int, floor: int, seed: int):
    """Signs texts. A node is the prefix of ``floor`` values in a tree, a tail holds the other values, the first ones highest."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        count = max(trees * depth, 64 * SKETCH)
        mul = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        add = rng.integers(0, 1 << 32, count, dtype=np.uint32)
        width = 62 // max(1, depth - floor) if depth > floor else 0  # bits of each value in a tail
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            sums, xors = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            nodes, tails = np.zeros((b.num_rows, trees), np.uint64), np.zeros((b.num_rows, trees), np.uint64)
            sketch = np.zeros((b.num_rows, SKETCH), np.uint64)
            for lo, hi, h, r in shingle_sets(b.column(2), size):
                if not len(h):
                    continue
                times = np.bincount(r, minlength=hi - lo)
                some = np.flatnonzero(times)
                at = (np.cumsum(times) - times)[some]
                n[lo:hi] = times
                sums[lo + some] = np.add.reduceat(tb.mix(h ^ np.uint64(0x5BF03635)), at)
                xors[lo + some] = np.bitwise_xor.reduceat(tb.mix(h + np.uint64(0x27D4EB2F)), at)
                short = (h >> np.uint64(32)).astype(np.uint32)
                for j in range(count):
                    least = np.minimum.reduceat(short * mul[j] + add[j], at).astype(np.uint64)
                    mixed = tb.mix(least + (np.uint64(j) << np.uint64(32)))
                    if j < 64 * SKETCH:
                        sketch[lo + some, j // 64] |= (mixed & np.uint64(1)) << np.uint64(j % 64)
                    t, k = divmod(j, depth)
                    if t >= trees:
                        continue
                    if k < floor:
                        nodes[lo + some, t] = tb.mix(nodes[lo + some, t] * np.uint64(0x9E3779B97F4A7C15) + mixed + np.uint64(1))
                    else:
                        tails[lo + some, t] = tails[lo + some, t] << np.uint64(width) | mixed >> np.uint64(64 - width)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, trees, 0))]), pa.int32()), pa.array(x[n > 0].ravel().view(np.int64))) for x in (nodes, tails)]
            columns = [b.column(0), b.column(1), pa.array(n), *[pa.array(x.view(np.int64)) for x in (sums, xors)], *lists, *[pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(SKETCH)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "set_a", "set_b", "nodes", "tails", *_SKETCH])

    return sign


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows arrive sorted by ``key``; one table for each key, held one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        marks = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in key], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            now = tuple(marks[lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def link_node(group: np.ndarray, side: np.ndarray, tail: np.ndarray, shortest: np.ndarray, sketch: np.ndarray, floor: int, depth: int, most: int) -> list[tuple[int, int]]:
    """Links (places of two members) that join the groups of a node's members, which are sorted by ``tail``.

    From the longest shared prefix to the shorter ones, members of different groups that share it, and are on different
    sides if there are two, are linked if their sketches differ in at most ``most`` bits. A member takes part down to its
    ``shortest`` prefix, so of a pair the longer of the two decides: the pair is at least as similar as both sizes demand.
    """
    _, now = np.unique(group, return_inverse=True)
    links, two = [], bool((side != side[0]).any())
    width = 62 // max(1, depth - floor) if depth > floor else 0
    for k in range(depth, floor - 1, -1):
        prefix = tail >> np.uint64(width * (depth - k))
        edges = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            names, size = np.unique(now[lo:hi], return_counts=True)
            if len(names) < 2:
                continue
            members = np.arange(lo, hi)
            free = shortest[lo:hi] <= k
            for x in members[free & (now[lo:hi] != names[size.argmax()])]:  # pairs within the largest group need no look
                other = members[free & (now[lo:hi] != now[x])]
                if two:
                    other = other[side[other] != side[x]]
                if not len(other):
                    continue
                near = other[np.bitwise_count(sketch[other] ^ sketch[x]).sum(axis=1) <= most]
                for name in np.unique(now[near]):
                    links.append((int(x), int(near[now[near] == name][0])))
                    now[now == name] = now[x]
    return links


def _walk(floor: int, depth: int, most: int):
    """Walks the sorted tries of nodes, which arrive sorted by (node, i, j, tail)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["node", "i", "j"]):
            column = lambda c: t.column(c).to_numpy()  # noqa: B023, E731
            side = column("block") if t.column("i")[0] != t.column("j")[0] else np.zeros(t.num_rows, np.int64)
            sketch = np.stack([column(c).view(np.uint64) for c in _SKETCH], axis=1)
            got = link_node(column("grp"), side, column("tail").view(np.uint64), column("shortest"), sketch, floor, depth, most)
            at, ids = np.array(got, np.int64).reshape(-1, 2), column("set_id")
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])

    return walk


def intersections(rows: np.ndarray, hashes: np.ndarray, m: int, other_rows: np.ndarray, other_hashes: np.ndarray, k: int, rare: int = 48) -> np.ndarray:
    """Sizes of the intersections of m sets with k others, given as (row, hash) entries."""
    order = np.argsort(other_hashes, kind="stable")
    other_rows, other_hashes = other_rows[order], other_hashes[order]
    first = np.searchsorted(other_hashes, hashes, "left")
    times = np.searchsorted(other_hashes, hashes, "right") - first
    out = np.zeros((m, k), np.float32)
    flat = out.reshape(-1)
    few = np.flatnonzero((times > 0) & (times <= rare))
    for lo, hi in tb.chunks(np.concatenate([[0], np.cumsum(times[few])]), 1 << 20):
        at = few[lo:hi]
        ends = np.cumsum(times[at])
        place = np.repeat(first[at] - ends + times[at], times[at]) + np.arange(int(ends[-1]))
        where, n = np.unique(np.repeat(rows[at].astype(np.int64), times[at]) * k + other_rows[place], return_counts=True)
        flat[where] += n
    # Hashes of many others: matrix products over a bounded number of columns.
    often = np.flatnonzero(times > rare)
    names, column = np.unique(hashes[often], return_inverse=True)
    order = np.argsort(column, kind="stable")
    often, column = often[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(names) + 512, 512))
    begin = first[often]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        base = column[lo]
        mine, theirs = np.zeros((m, 512), np.float32), np.zeros((k, 512), np.float32)
        mine[rows[often[lo:hi]], column[lo:hi] - base] = 1
        for at in lo + np.flatnonzero(np.diff(column[lo:hi], prepend=-1)):
            theirs[other_rows[begin[at] : begin[at] + times[often[at]]], column[at] - base] = 1
        out += mine @ theirs.T
    return out


def _linker(size: int, similarity: float):
    def link_cell(part: pa.Table) -> pa.RecordBatch:
        hashes, rows = [], []
        for lo, _, h, r in shingle_sets(part.column("text").combine_chunks(), size):
            hashes.append(h)
            rows.append(r + lo)
        h, r = np.concatenate(hashes), np.concatenate(rows)
        ids, copies, block = (part.column(c).to_numpy() for c in ("set_id", "copies", "block"))
        one = part.column("i")[0].as_py() == part.column("j")[0].as_py()
        left = np.flatnonzero(block == block[0]) if not one else np.arange(len(ids))
        right = np.flatnonzero(block != block[0]) if not one else left
        n, place = np.bincount(r, minlength=len(ids)), np.zeros(len(ids), np.int64)
        place[left], mine = np.arange(len(left)), np.isin(r, left)
        a_rows, a_hashes = place[r[mine]], h[mine]
        place[right], theirs = np.arange(len(right)), np.isin(r, right)
        linked = np.zeros((len(left), len(right)), bool)
        both = intersections(a_rows, a_hashes, len(left), place[r[theirs]], h[theirs], len(right))
        docs, texts, root = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), ids.copy()
        for lo in range(0, len(left), 256):  # in strips, so that what is derived from the intersections stays small
            some = left[lo : lo + 256]
            union = n[some][:, None] + n[right][None, :] - both[lo : lo + 256]
            near = both[lo : lo + 256] >= (similarity - 1e-9) * np.maximum(union, 1)
            if one:
                near[np.arange(len(some)), lo + np.arange(len(some))] = False
            linked[lo : lo + 256] = near
            docs[some] += near @ copies[right]
            texts[some] += near.sum(axis=1)
            if not one:
                docs[right] += copies[some] @ near
                texts[right] += near.sum(axis=0)
        last = np.iinfo(np.int64).max
        while True:
            before = root.copy()
            for lo in range(0, len(left), 256):
                some, near = left[lo : lo + 256], linked[lo : lo + 256]
                root[some] = np.minimum(root[some], np.where(near, root[right][None, :], last).min(axis=1, initial=last))
                root[right] = np.minimum(root[right], np.where(near, root[some][:, None], last).min(axis=0, initial=last))
            if (before == root).all():
                break
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(docs), pa.array(texts), pa.array(root)], names=["set_id", "linked_docs", "linked_texts", "root"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["grp", "i", "j"]):
            yield link_cell(t)

    return link


def _cells(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (with block and blocks) once for each cell, that is pair of blocks of one ``key``, in which they are; sorted by cell."""
    spread = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return spread.repartition(slices(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j", *order)


def candidate_groups(sets: DataFrame, floor: int, depth: int, shortest: np.ndarray, most: int, node_block: int) -> DataFrame:
    """(node, component): sets of ``sets`` (set_id, n, nodes, tails, sketch) that sketch-verified links of the forest join; see the module's docstring."""
    least = F.element_at(F.array(*[F.lit(int(x)) for x in shortest]), F.least(F.col("n"), F.lit(len(shortest) - 1)).cast("int") + 1)
    member = sets.where(least <= depth).select("set_id", least.alias("shortest"), F.explode(F.arrays_zip("nodes", "tails")).alias("x")).select("set_id", "shortest", "x.nodes", "x.tails").toDF("set_id", "shortest", "node", "tail")
    node = member.groupBy("node").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("last"), F.count("*").alias("members")).where("hub < last").drop("last")
    shared = staged(member.join(node, "node"), "shared")
    sketch = sets.select("set_id", *_SKETCH)
    # Every set and the first set of its nodes. A set is first in as many nodes as there are trees at most.
    pairs = shared.where("set_id <> hub").select("set_id", "hub").distinct()
    both = pairs.join(sketch, "set_id").join(sketch.select(F.col("set_id").alias("hub"), *[F.col(c).alias(f"h{c}") for c in _SKETCH]), "hub")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"h{c}"))) for c in _SKETCH), F.lit(0))
    first = staged(both.where(apart <= most).select(F.col("set_id").alias("a"), F.col("hub").alias("b")), "first")
    joined = staged(components(first), "joined")
    # Nodes with sets of different groups are walked.
    named = shared.join(joined.select(F.col("node").alias("set_id"), F.col("component").alias("grp")), "set_id", "left").withColumn("grp", F.coalesce("grp", "set_id"))
    mixed = named.groupBy("node").agg(F.min("grp").alias("least"), F.max("grp").alias("largest")).where("least < largest").select("node")
    rows = named.join(mixed, "node").join(sketch, "set_id").withColumn("blocks", F.ceil(F.col("members") / node_block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("long")).select("node", "block", "blocks", "set_id", "grp", "tail", "shortest", *_SKETCH)
    more = staged(_cells(rows, "node", ["tail"]).mapInArrow(_walk(floor, depth, most), _EDGE).distinct(), "more")
    return components(first.union(more))


def near_duplicates(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, trees: int = 32, depth: int = 8, recall: float = 0.9999, slack: float = 0.16, seed: int = 7, block_docs: int = 2000, block_shingles: int = 1_000_000, node_block: int = 4000
) -> DataFrame:
    """(doc_id, text_key, class_id, is_first, n_links, n_texts, n_copies) for each row of ``docs`` (doc_id, text); see the module's docstring.

    ``text_key`` is xxhash64 of the text. ``is_first`` marks the one document of each class that has the smallest doc_id
    (then text_key), and rows that are no document to others.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    shortest = shortest_prefixes(trees, depth, similarity, recall)
    floor, most = int(shortest.min()), int(64 * SKETCH * (1 - similarity + slack) / 2)
    signed = staged(docs.mapInArrow(_signer(size, trees, depth, floor, seed), _SIGNED), "signed")
    known = signed.where("doc_id is not null and n > 0")
    first = F.min(F.struct("doc_id", "text_key"))
    repeats = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    count = F.count_distinct("doc_id") if repeats else F.count("*")
    sets = known.groupBy("set_a", "set_b", "n").agg(first.alias("first"), count.alias("copies"), *[F.any_value(c).alias(c) for c in ("nodes", "tails", *_SKETCH)])
    sets = staged(sets.select(F.monotonically_increasing_id().alias("set_id"), "*"), "sets")
    grouped = candidate_groups(sets, floor, depth, shortest, most, node_block)
    # Blocks and cells: a group of bounded size is one cell.
    sized = staged(sets.select("set_id", "n", "copies", "first").join(grouped.select(F.col("node").alias("set_id"), F.col("component").alias("grp")), "set_id"), "groups")
    blocks = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("long")).select("grp", "blocks", "block", "set_id", "copies", "first.*")
    text = docs.where("doc_id is not null")
    text = text.groupBy("doc_id", "text_key").agg(F.min("text").alias("text")) if repeats else text
    # Hashed by hint, so that the plan is the same at every size: the side of the groups is built, the texts stream by.
    placed = placed.hint("shuffle_hash").join(text, ["doc_id", "text_key"]).drop("doc_id", "text_key")
    linked = staged(_cells(placed, "grp", ["set_id"]).mapInArrow(_linker(size, similarity), _CELL), "linked")
    links = linked.groupBy("set_id").agg(F.sum("linked_docs").alias("linked_docs"), F.sum("linked_texts").alias("n_texts"), F.min("root").alias("root"))
    if not blocks.where("blocks > 1").isEmpty():
        joined = components(linked.where("set_id <> root").select("set_id", "root"), "set_id", "root")
        links = links.join(joined.withColumnsRenamed({"node": "set_id", "component": "whole"}), "set_id", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    links = sets.select("set_id", "set_a", "set_b", "n", "copies", "first").join(links, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = links.groupBy("root").agg(F.min("first").alias("class"))
    links = staged(links.join(named, "root").select("set_a", "set_b", "n", "copies", "linked_docs", "n_texts", "class"), "links")
    # The only join with all rows: equal sets may be many rows, of which Spark splits a partition that is too large.
    out = signed.select("doc_id", "text_key", "n", "set_a", "set_b").join(links, ["set_a", "set_b", "n"], "left")
    copies = F.coalesce("copies", F.lit(1))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class.doc_id", "doc_id"))
    is_first = F.coalesce((F.col("class.doc_id") == F.col("doc_id")) & (F.col("class.text_key") == F.col("text_key")), F.lit(True))
    linked_docs = F.coalesce("linked_docs", F.lit(0)) + copies - F.when(F.col("doc_id").isNull() & F.col("copies").isNotNull(), 0).otherwise(1)
    return out.select("doc_id", "text_key", class_id.alias("class_id"), is_first.alias("is_first"), linked_docs.alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), copies.alias("n_copies"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "is_first")


#: All pairs by an inverted index, and the closure of the links: for small tables.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(5, len(w)) AS k FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM k) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, reach.root FROM reach JOIN l ON l.x = reach.doc_id),
class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
first AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(l.y), d.doc_id)) AS first FROM documents d LEFT JOIN l ON l.x = d.doc_id AND l.same GROUP BY d.doc_id),
links AS (SELECT l.x AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT l.same THEN f.first END) AS n_texts, count(*) FILTER (l.same) AS copies FROM l JOIN first f ON f.doc_id = l.y GROUP BY l.x)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts, coalesce(copies, 0) + 1 AS n_copies
FROM documents d JOIN class USING (doc_id) LEFT JOIN links USING (doc_id)
"""

QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES = {"op3_ngram_jaccard_join": OP3_SQL}
