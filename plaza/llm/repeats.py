"""Repeated byte strings of a corpus by a distributed enhanced suffix array and its common-prefix interval tree.

Texts are UTF-8 bytes; repeats of at least ``least`` bytes (50) never cross documents.

Distribution. Every window of ``least`` bytes holds ``least - K + 1`` strings of K bytes; the one of smallest hash (the leftmost,
if equal) is its anchor. Equal windows have equal anchors at equal offsets, so they meet if anchors are dealt by
their hash. That is done in two rounds, so that text which is nowhere repeated is not shuffled as contexts:

1. Each document deals its short anchor hashes; a bucket of hashes answers the documents whose anchors another document has too.
2. Documents meet their answers and deal those anchors with their contexts, the bytes of all windows that they anchor (76 at most,
   of which the K of the anchor itself stay behind).

All of it travels in compressed blocks for buckets, whose number grows with the bytes of the corpus. A bucket is of bounded size unless one
anchor of K bytes stands in very many different contexts: those meet in one bucket, at about 300 bytes of memory each. What
many documents share is summed before it is dealt: hashes that several documents of one Arrow batch have are answered there, and of contexts
that several documents of one block of documents have, only the smallest document's goes on, and the others are settled there.

Suffix array. In a bucket the distinct contexts are suffixes that begin at the anchor: they are sorted by anchor and bytes, the
longest common prefixes of neighbours are taken, and one stack scan gives the interval tree (``lcp_intervals``). The contexts of a
node share that many bytes from the anchor on; where they also share the bytes to the left that complete a window, they
are the occurrences of one repeat, all of them and not just neighbours. Left extensions are tested for diversity (``Bucket.groups``): a group
whose members all go on alike to the left is passed on until they differ, so what comes out is maximal. ``maximal_repeats`` returns
these groups as far as contexts reach, so a repeat of over 76 bytes appears as its overlapping parts.

Removal. ``covered_by_earlier`` takes the maximal repeats of each bucket, reduces each to the smallest doc_id that holds it and returns
the byte ranges of its other occurrences, packed per block of documents; ``remove_repeats`` joins them to the texts.

Cases: a null or empty text has no bytes; a text shorter than ``least`` keeps all; of equal texts the smallest doc_id keeps
its bytes; a string that is repeated only inside one document stays; rows that repeat a doc_id are one document with
the smallest of their texts, and each row is returned with its result; a null doc_id comes before all others; long texts are cut
into overlapping segments, without losing a window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import textbytes as tb

K = 24
_SEGMENT = 2 << 20
_BLOCK = "bucket bigint, block binary"
_KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _planes(a: np.ndarray) -> bytes:
    """The bytes of integers, plane by plane."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(parts: list[np.ndarray]) -> bytes:
    """Arrays of integers as one compressed block."""
    raw = [_planes(p) if len(p) else b"" for p in parts]
    head = np.array([len(x) for x in raw], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(raw))


def unpack(block: bytes, kinds: list[type]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw[:at], np.int64), kinds, strict=True):
        out.append(_unplanes(raw[at : at + size], kind) if size else np.zeros(0, kind))
        at += size
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def anchors(part: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Hash, row, start of the first and number of the windows, and offset from that start, of each anchor of a slice of rows."""
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    n = len(part)
    if n < least:
        return none
    up, down = tb.powers(n), tb.powers(n, pow(tb.BASE, -1, 1 << 64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = tb.mix((total[K:] - total[:-K]) * down[: n - K + 1])
    packed = (h & np.uint64(0xFFFFFFFFFE000000)) | np.arange(len(h), dtype=np.uint64)
    width, span, low = least - K + 1, 1, packed
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - least + 1], low[width - span : width - span + n - least + 1])
    at = (low & np.uint64(0x1FFFFFF)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(rows[: n - least + 1] == rows[least - 1 :])
    if not len(windows):
        return none
    at = at[windows]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = windows[first]
    return h[at[first]], rows[start], start, count, at[first] - start


def _segments(offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of segments of at most ``_SEGMENT`` bytes; those of one row overlap by ``least - 1``."""
    starts, ends, rows = [], [], []
    for row in np.flatnonzero(np.diff(offsets) > _SEGMENT):
        s = np.arange(offsets[row], offsets[row + 1] - least + 1, _SEGMENT - least + 1)
        starts.append(s)
        ends.append(np.minimum(s + _SEGMENT, offsets[row + 1]))
        rows.append(np.full(len(s), row))
    short = np.flatnonzero(np.diff(offsets) <= _SEGMENT)
    return (np.concatenate([offsets[short], *starts]), np.concatenate([offsets[short + 1], *ends]), np.concatenate([short, *rows]))


_CONTEXT = [np.uint64, np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.int64]
_RANGE = [np.int64, np.int64, np.uint8]
_SHARED = [np.int64, np.uint64]
_TEXT = [np.int64, np.int64, np.uint8]
_ROUTED = "to_docs boolean, bucket bigint, block binary"


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of anchors, cut to so many bits; equal short hashes of different anchors only cost bytes."""
    return tb.mix(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - bits)


def _home(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (tb.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
    return list(zip(edges, edges[1:], strict=False))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    first = np.ones(len(columns[0]), bool)
    if len(first):
        first[1:] = False
        for c in columns:
            first[1:] |= c[1:] != c[:-1]
    return first


def _routed(to_docs: bool, buckets: list[int], blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to_docs] * len(blocks), pa.bool_()), pa.array(buckets, pa.int64()), pa.array(blocks, pa.binary())], names=["to_docs", "bucket", "block"])


def _to_docs(buckets: int, doc: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows about documents as blocks for the documents' buckets."""
    home = _home(doc, buckets)
    order = np.lexsort((columns[0], doc, home))
    names, blocks = [], []
    for lo, hi in _runs(home[order]):
        at = order[lo:hi]
        names.append(int(home[at[0]]))
        blocks.append(pack([np.diff(doc[at], prepend=0), *[c[at] for c in columns]]))
    return _routed(True, names, blocks)


def _marks(least: int, buckets: int, bits: int):
    """Round 1: (short hash, document) for the hashes' buckets; hashes of several documents of a batch are answered at once."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy()
            data, offsets = tb.flat(b.column(1))
            found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for part, local, rows, _ in _slices(data, offsets, least):
                h, seg, *_ = anchors(part, local, least)
                found.append(_short(h, bits))
                owner.append(docs[rows[seg]])
            h, doc = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((doc, h))
            order = order[_starts(h[order], doc[order])]
            h, doc = h[order], doc[order]
            first = np.flatnonzero(_starts(h))
            times = np.diff(np.append(first, len(h)))
            known = np.repeat(times > 1, times)
            yield _to_docs(buckets, doc[known], h[known])
            h, doc = h[first], doc[first]
            bucket = h % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            runs = _runs(bucket[order])
            yield _routed(False, [int(bucket[order[lo]]) for lo, _ in runs], [pack([doc[order[lo:hi]], np.diff(h[order[lo:hi]], prepend=np.uint64(0))]) for lo, hi in runs])

    return marks


def _answer(buckets: int):
    def answer(table: pa.Table) -> pa.Table:
        if table.column("to_docs")[0].as_py():
            return table
        got = [unpack(x, _SHARED) for x in table.column("block").to_pylist()]
        doc, h = np.concatenate([g[0] for g in got]), np.concatenate([np.cumsum(g[1], dtype=np.uint64) for g in got])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(_starts(h))
        times = np.diff(np.append(first, len(h)))
        known = np.repeat(doc[first] != doc[np.append(first[1:], len(h)) - 1], times)
        return pa.Table.from_batches([_to_docs(buckets, doc[known], h[known])])

    return answer


def _slices(data: np.ndarray, offsets: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets of segments, their rows and their places in the rows, for slices of about ``_SEGMENT`` bytes."""
    starts, ends, rows = _segments(offsets, least)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    for lo, hi in tb.chunks(cuts, _SEGMENT):
        yield data[ragged(starts[lo:hi], (ends - starts)[lo:hi])], cuts[lo : hi + 1] - cuts[lo], rows[lo:hi], starts[lo:hi] - offsets[rows[lo:hi]]


def _contexts(least: int, buckets: int, bits: int, settle: bool):
    """Round 2: the contexts of answered anchors for the hashes' buckets; with ``settle`` copies inside a block of documents end here."""

    def contexts(texts: pa.Table, answers: pa.Table) -> pa.Table:
        doc, data, offsets = _unblocked(texts)
        got = [unpack(x, _SHARED) for x in answers.column("block").to_pylist()]
        asked = np.unique(np.concatenate([np.zeros(0, np.uint64), *[tb.mix(np.cumsum(g[0]).view(np.uint64)) ^ g[1] for g in got]]))
        kept = []
        for part, local, rows, place in _slices(data, offsets, least):
            h, seg, start, count, left = anchors(part, local, least)
            owner = doc[rows[seg]]
            key = tb.mix(owner.view(np.uint64)) ^ _short(h, bits)
            at = np.minimum(np.searchsorted(asked, key), max(0, len(asked) - 1))
            known = np.flatnonzero(asked[at] == key) if len(asked) else np.zeros(0, np.int64)
            h, seg, start, count, left, owner = (x[known] for x in (h, seg, start, count, left, owner))
            length = count + least - 1
            same = tb.mix(tb.word_hashes(part, start, start + length) ^ (h + left.astype(np.uint64)))
            outer = part[ragged(np.stack([start, start + left + K], 1).ravel(), np.stack([left, length - left - K], 1).ravel())]
            kept.append((h, left, length, same, owner, place[seg] + start - local[seg], outer))
        if not kept:
            return pa.Table.from_batches([_routed(False, [], [])])
        h, left, length, same, owner, place, outer = (np.concatenate(x) for x in zip(*kept, strict=True))
        where = np.cumsum(length - K) - (length - K)
        bucket = (tb.mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((owner, same, h, bucket))
        first = _starts(same[order], h[order])
        heads, entry = order[first], np.cumsum(first) - 1
        out = []
        if settle and len(order):
            late = owner[order] != owner[heads][entry]
            out.append(_to_docs(buckets, owner[order[late]], place[order[late]], length[order[late]].astype(np.uint8)))
            order, entry = order[~late], entry[~late]
        times = np.bincount(entry, minlength=len(heads))
        places = np.concatenate([[0], np.cumsum(times)])
        names, blocks = [], []
        for lo, hi in _runs(bucket[heads]):
            e, p = heads[lo:hi], order[places[lo] : places[hi]]
            names.append(int(bucket[e[0]]))
            blocks.append(pack([np.diff(h[e], prepend=np.uint64(0)), left[e].astype(np.uint8), length[e].astype(np.uint8), outer[ragged(where[e], length[e] - K)], times[lo:hi].astype(np.uint32), owner[p], place[p]]))
        return pa.Table.from_batches([*out, _routed(False, names, blocks)])

    return contexts


def _deal(buckets: int):
    """The texts as compressed blocks for the documents' buckets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy()
            data, offsets = tb.flat(b.column(1))
            home = _home(doc, buckets)
            order = np.lexsort((doc, home))
            for lo, hi in _runs(home[order]):
                at = order[lo:hi]
                length = offsets[at + 1] - offsets[at]
                block = pack([np.diff(doc[at], prepend=0), length, data[ragged(offsets[at], length)]])
                yield pa.RecordBatch.from_arrays([pa.array([int(home[at[0]])], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "block"])

    return deal


def _unblocked(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, bytes and offsets of the blocks of texts."""
    got = [unpack(x, _TEXT) for x in texts.column("block").to_pylist()]
    doc = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(g[0]) for g in got]])
    data = np.concatenate([np.zeros(0, np.uint8), *[g[2] for g in got]])
    return doc, data, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[g[1] for g in got]]))])


def _outer_hashes(text: np.ndarray, where: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, in slices, so that the sums stay small."""
    out = np.zeros(len(where), np.uint64)
    for lo, hi in tb.chunks(np.append(where, len(text)), _SEGMENT):
        base = where[lo]
        out[lo:hi] = tb.word_hashes(text[base : where[hi - 1] + length[hi - 1]], where[lo:hi] - base, where[lo:hi] - base + length[lo:hi])
    return out


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The interval tree of a suffix array by one stack scan: lo, hi, depth, and depth of the parent (or ``least - 1``).

    ``lcp[i]`` is the longest common prefix of suffixes i and i + 1; intervals of a depth under ``least`` are left out.
    """
    los, his, depths, parents = [], [], [], []
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*lcp.tolist(), 0]):
        lo = i
        while stack and stack[-1][1] > d:
            lo, depth = stack.pop()
            los.append(lo)
            his.append(i)
            depths.append(depth)
            parents.append(max(d, stack[-1][1] if stack else 0, least - 1))
        if d >= least and (not stack or stack[-1][1] < d):
            stack.append((lo, d))
    return tuple(np.array(x, np.int64) for x in (los, his, depths, parents))


class Bucket:
    """The distinct contexts of one bucket as a suffix array at their anchors, with its interval tree."""

    def __init__(self, blocks: list[bytes], least: int):
        self.least = least
        got = [unpack(b, _CONTEXT) for b in blocks]
        h = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        left, length, text, times, self.doc, self.place = (np.concatenate([g[i] for g in got]) for i in range(1, 7))
        left, length, times = left.astype(np.int64), length.astype(np.int64), times.astype(np.int64)
        where = np.cumsum(length - K) - (length - K)
        same = tb.mix(_outer_hashes(text, where, length - K) ^ (h + left.astype(np.uint64)))
        # Contexts that are equal in several blocks become one.
        order = np.lexsort((same, h))
        first = np.ones(len(order), bool)
        first[1:] = (same[order][1:] != same[order][:-1]) | (h[order][1:] != h[order][:-1])
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(first) - 1
        self.entry = np.repeat(entry, times)
        heads = order[first]
        self.hash, self.left, self.length, self.where, self.text = h[heads], left[heads], length[heads], where[heads], text
        self.least_doc = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(self.least_doc, self.entry, self.doc)
        self._tree()

    def _tree(self) -> None:
        """Sorts the contexts that share an anchor with another."""
        more = np.zeros(len(self.hash), bool)
        equal = self.hash[1:] == self.hash[:-1]
        more[1:] |= equal
        more[:-1] |= equal
        e = np.flatnonzero(more)
        right = self.length[e] - self.left[e] - K
        width = -(-(self.least - K) // 8) * 8
        suffix = np.zeros((len(e), width), np.uint8)
        suffix[np.repeat(np.arange(len(e)), right), ragged(np.zeros(len(e), np.int64), right)] = self.text[ragged(self.where[e] + self.left[e], right)]
        keys = suffix.view(">u8")
        order = np.lexsort((right, *[keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)], self.hash[e]))
        self.suffixes, suffix, right = e[order], suffix[order], right[order]
        self.right = right + K
        if len(order) > 1:
            differ = suffix[1:] != suffix[:-1]
            lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            lcp = K + np.minimum(lcp, np.minimum(right[1:], right[:-1]))
            lcp[self.hash[self.suffixes][1:] != self.hash[self.suffixes][:-1]] = 0
        else:
            lcp = np.zeros(0, np.int64)
        self.lcp = lcp
        self.lo, self.hi, self.depth, self.parent = lcp_intervals(lcp, K)
        # Hashes of the j bytes to the left of the anchor, for all j.
        lefts = self.left[self.suffixes]
        most = self.least - K
        self.back = np.zeros((most + 1, len(lefts)), np.uint64)
        for j in range(1, most + 1):
            has = lefts >= j
            byte = np.zeros(len(lefts), np.uint64)
            byte[has] = self.text[(self.where[self.suffixes] + lefts - j)[has]]
            self.back[j] = tb.mix(self.back[j - 1] * np.uint64(0x100000001B3) + byte + np.uint64(1))

    def level(self, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes in which suffixes agree on ``need`` bytes: members (indices of suffixes that own the window), node, left bytes' hash."""
        at = np.flatnonzero((self.parent < need) & (self.depth >= need))
        size = self.hi[at] - self.lo[at] + 1
        member, node = ragged(self.lo[at], size), np.repeat(at, size)
        j = self.least - need
        own = (self.left[self.suffixes[member]] >= j) & (self.right[member] >= need)
        member, node = member[own], node[own]
        return member, node, self.back[j][member]

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Repeats that cannot be extended to the left: members (suffixes) of the groups, where each group begins, left bytes and right bytes.

        The suffixes of a node that share the j bytes to the left that complete a window are a group. Where all of them
        share one more byte to the left, the group is not diverse: it comes out with the longest left extension that all share, or as the same group
        of the same node at the next j. Every repeated window lies in the strings of the group of its own occurrences.
        """
        most = self.least - K
        for j in range(most + 1):
            need = self.least - j
            member, node, back = self.level(need)
            if not len(member):
                continue
            order = np.lexsort((node, back))
            member, node, back = member[order], node[order], back[order]
            begin = np.flatnonzero(_starts(node, back))
            size = np.diff(np.append(begin, len(member)))
            long = np.full(len(begin), j)
            pending = np.flatnonzero(size > 1)
            out = []
            for left in range(j + 1, most + 2):
                if not len(pending):
                    break
                at, heads = ragged(begin[pending], size[pending]), np.cumsum(size[pending]) - size[pending]
                if left <= most:
                    byte, has = self.back[left][member[at]], self.left[self.suffixes[member[at]]] >= left
                    alike = np.logical_and.reduceat(has, heads) & (np.minimum.reduceat(byte, heads) == np.maximum.reduceat(byte, heads))
                else:
                    alike = np.zeros(len(pending), bool)
                out.append(pending[~alike])  # diverse: maximal to the left
                pending = pending[alike]
                if left == j + 1:
                    pending = pending[self.parent[node[begin[pending]]] >= need - 1]  # the others are groups of the same node again
                long[pending] = left
            found = np.sort(np.concatenate([np.zeros(0, np.int64), *out]))
            if len(found):
                yield member[ragged(begin[found], size[found])], np.cumsum(size[found]) - size[found], long[found], self.depth[node[begin[found]]]

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, start and length of the occurrences of repeats in other documents than the first that has them."""
        late = self.doc > self.least_doc[self.entry]
        out = [(self.doc[late], self.place[late], self.length[self.entry][late])]
        first, found = self.least_doc[self.suffixes], [np.zeros((0, 3), np.int64)]
        for member, begin, left, right in self.groups():
            size = np.diff(np.append(begin, len(member)))
            later = np.repeat(np.minimum.reduceat(first[member], begin), size) < first[member]
            found.append(np.stack([member, np.repeat(left, size), np.repeat(right, size)], axis=1)[later])
        k, left, right = np.unique(np.concatenate(found), axis=0).T
        if len(k):
            e = self.suffixes[k]
            order = np.argsort(e, kind="stable")
            e, left, right = e[order], left[order], right[order]
            begin = np.concatenate([[0], np.cumsum(np.bincount(e, minlength=len(self.hash)))])  # the repeats of a context stand together
            mine = np.flatnonzero(~late)
            runs = begin[self.entry[mine] + 1] - begin[self.entry[mine]]
            place, run = np.repeat(mine, runs), ragged(begin[self.entry[mine]], runs)
            out.append((self.doc[place], self.place[place] + self.left[e[run]] - left[run], left[run] + right[run]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def repeats(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Maximal repeats within contexts: length, and doc, start and context of every occurrence."""
        for e in np.flatnonzero(np.bincount(self.entry, minlength=len(self.hash)) > 1):
            at = np.flatnonzero(self.entry == e)
            yield int(self.length[e]), self.doc[at], self.place[at], np.full(len(at), e)
        for member, begin, left, right in self.groups():
            for lo, hi, before, after in zip(begin.tolist(), [*begin[1:].tolist(), len(member)], left.tolist(), right.tolist(), strict=True):
                mine = np.sort(member[lo:hi])
                if self.lcp[mine[0] : mine[-1]].min() > after:
                    continue  # all of them go on alike to the right: a deeper node has them
                at = np.flatnonzero(np.isin(self.entry, self.suffixes[mine]))
                yield after + before, self.doc[at], self.place[at] + self.left[self.entry[at]] - before, self.entry[at]


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text), one row for each doc_id; a null doc_id stands before all others."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if keyed.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return keyed
    return keyed.groupBy("doc_id").agg(F.min("text").alias("text"))


def _buckets(docs: DataFrame, bucket_bytes: int) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def _answered(docs: DataFrame, least: int, buckets: int, settle: bool) -> tuple[DataFrame, DataFrame]:
    """The texts in blocks, and the routed contexts of anchors that several documents have."""
    bits = min(64, 32 + max(1, buckets - 1).bit_length())
    texts = docs.mapInArrow(_deal(buckets), _BLOCK)
    answers = docs.mapInArrow(_marks(least, buckets, bits), _ROUTED).groupBy("to_docs", "bucket").applyInArrow(_answer(buckets), _ROUTED)
    return texts, texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_contexts(least, buckets, bits, settle), _ROUTED)


def maximal_repeats(docs: DataFrame, least: int = 50, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(repeat_id, length, doc_id, start): all occurrences of each maximal repeat of ``docs`` (doc_id, text), as far as contexts reach."""
    docs = _documents(docs)

    def groups(table: pa.Table) -> pa.Table:
        bucket, rows = Bucket(table.column("block").to_pylist(), least), [[], [], [], []]
        for k, (length, doc, start, _) in enumerate(bucket.repeats()):
            for column, values in zip(rows, (np.full(len(doc), table.column("bucket")[0].as_py() << 32 | k), np.full(len(doc), length), doc, start), strict=True):
                column.append(values)
        columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in rows]
        return pa.Table.from_arrays(columns, names=["repeat_id", "length", "doc_id", "start"])

    _, routed = _answered(docs, least, _buckets(docs, bucket_bytes), settle=False)
    return routed.groupBy("bucket").applyInArrow(groups, "repeat_id bigint, length bigint, doc_id bigint, start bigint")


def covered_by_earlier(docs: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The texts in blocks, and blocks of the byte ranges that a document with a smaller doc_id holds too, for the same buckets."""

    def ranges(table: pa.Table) -> pa.Table:
        if table.column("to_docs")[0].as_py():
            return table
        doc, start, length = Bucket(table.column("block").to_pylist(), least).ranges()
        return pa.Table.from_batches([_to_docs(buckets, doc, start, length.astype(np.uint8))])

    texts, routed = _answered(docs, least, buckets, settle=True)
    return texts, routed.groupBy("to_docs", "bucket").applyInArrow(ranges, _ROUTED)


def _kept(texts: pa.Table, blocks: pa.Table) -> pa.Table:
    got = [unpack(b, _RANGE) for b in blocks.column("block").to_pylist()]
    doc = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(g[0]) for g in got]])
    start = np.concatenate([np.zeros(0, np.int64), *[g[1] for g in got]])
    length = np.concatenate([np.zeros(0, np.uint8), *[g[2] for g in got]]).astype(np.int64)
    order = np.argsort(doc, kind="stable")
    doc, start, length = doc[order], start[order], length[order]
    ids, data, offsets = _unblocked(texts)
    lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
    out = []
    for k in range(len(ids)):
        text = data[offsets[k] : offsets[k + 1]]
        if lo[k] == hi[k]:
            out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
            continue
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, start[lo[k] : hi[k]], 1)
        np.add.at(step, start[lo[k] : hi[k]] + length[lo[k] : hi[k]], -1)
        gone = np.cumsum(step)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, least: int = 50, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    one = _documents(docs)
    texts, ranges = covered_by_earlier(one, least, _buckets(one, bucket_bytes))
    kept = texts.groupBy("bucket").cogroup(ranges.groupBy("bucket")).applyInArrow(_kept, _KEPT)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"))
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = rows.join(kept, "doc_id")
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_repeated_bytes": op9_repeated_bytes}
