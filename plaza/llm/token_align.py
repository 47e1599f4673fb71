"""Alignment of two tokenizers by merge paths: which tokens of A and of B cover the same bytes, and how often ids meet.

A is a byte-level BPE, B a sentencepiece BPE with byte fallback. Both ends of all tokens of a text are two sorted lists of byte
offsets. Where both have an end, a group is over, so groups come from merging the lists. The merge is cut into independent pieces
of equal work: a binary search on the diagonal ``i + j = d`` finds how many ends of each list are among the first ``d`` of both, so
each piece takes ``steps`` ends of the path, wherever they lie. A text whose path is one piece is merged where it is read; the pieces
of longer ones are dealt to all tasks. A piece gives the groups inside it, and what stands open at its edges, and ``stitch`` closes
these with what the neighbouring pieces left open.

Long texts are encoded in parts. Parts are cut at a space between two ASCII letters, where no token of either tokenizer crosses (A's pattern
begins a new word there, and no piece of B has a space after another character), so the ids are those of the whole text. Only a text without
such places is encoded in one go.

How many documents hold an id pair is counted with partial sums. To bring the counts back to the documents, the pairs that more than a
``frequent``-th of all (document, pair) rows have are broadcast: there are fewer than ``frequent`` of them, whatever the corpus. Each
other pair has few rows, so a shuffle by pair has no hot key.

Cases: a null or empty text, and one that its tokens do not spell (U+2581 in it, say), has no tokens and no groups, and counts for no pair; a row is a
document, so rows that repeat an id or a text count each; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaza.llm.shared import slices, staged

SHIFT = 16  # an id pair is ``a << SHIFT | b``
_SEAM = re.compile(r"[A-Za-z] (?=[A-Za-z])")
Known = tuple[bytes, bytes, bool]
_HOLDER = "plaza_token_pairs_of_process"
_DOCUMENT = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha256 string, groups string, pairs array<bigint>, times array<bigint>"
_OPEN = "piece int, ok boolean, start_a bigint, start_b bigint, ids_a binary, ids_b binary"
_MERGED = "row bigint, doc_id bigint, piece int, ok boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, closed boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, groups string, pairs array<bigint>, times array<bigint>"


class Pair:
    """The two tokenizers and the bytes of their tokens; the ids of frequent words are kept between texts."""

    def __init__(self, path_a: str, path_b: str, most: int = 300_000):
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the byte-level alphabet: other bytes follow from U+0100 on
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        with open(path_a, encoding="utf-8") as f:
            described = json.load(f)
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in described["model"]["vocab"].items() if entry not in special}
        self.path_a, self.most, self.held = path_a, most, 0
        self.known: dict[str, Known] = {}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = _table({i: b for b, i in ranks.items()} | {i: t.encode() for t, i in special.items()})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = _table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)})
        self.seams = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Each id with what may follow it: a comma, a bar, a semicolon, or nothing.
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = np.array([f"{i}{c}" for i in range(most) for c in (",", "|", ";", "")], object)
        self.kind = np.dtype("<u2" if most <= 1 << 16 else "<u4")

    @classmethod
    def of_process(cls, path_a: str, path_b: str) -> Pair:
        """One for all tasks of a worker process. Functions travel by value, so a module of its own keeps it."""
        kept, name = sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER)), f"{path_a}:{path_b}"
        if name not in vars(kept):
            setattr(kept, name, cls(path_a, path_b))
        return getattr(kept, name)

    @functools.cached_property
    def slow(self) -> Tokenizer:
        out = Tokenizer.from_file(self.path_a)
        out.encode_special_tokens = True
        return out

    def parts(self, text: str, most: int) -> list[str]:
        """The text without the spaces at which it is cut, in parts of ``most`` characters or a little more."""
        out, at = [], 0
        while self.seams and len(text) - at > most and (m := _SEAM.search(text, at + most)):
            out.append(text[at : m.start() + 1])
            at = m.end()
        return [*out, text[at:]]

    def encode_a(self, text: str) -> list[int]:
        """Ids of a space and ``text``. The fast encoder's time is the square of a run's length, so long runs go to the other."""
        if len(text) > 1000 and (max(map(len, text.split(" "))) > 1000 or " " * 1000 in text):
            return self.slow.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def _one(self, text: str) -> Known:
        """Ids of A and B of a text, and whether they spell a space and the text; if not, none."""
        a, b, want = self.encode_a(text), self.b.encode(text), b" " + text.encode()
        ok = bool(text) and b"".join(self.bytes_a[a].tolist()) == want == b"".join(self.bytes_b[b].tolist())
        return (array("i", a).tobytes(), array("i", b).tobytes(), True) if ok else (b"", b"", False)

    def _learn(self, words: list[str]) -> dict[str, Known]:
        """The same for words without white space at their edges, encoded together and cut at their ends."""
        out = {w: self._one(w) for w in words if len(w) > 1000}
        words = [w for w in words if len(w) <= 1000]
        text, cut, upto = " ".join(words), [], np.cumsum([len(w.encode()) + 1 for w in words])
        for ids, table, size in ((self.fast.encode_ordinary(" " + text), self.bytes_a, self.size_a), (self.b.encode(text), self.bytes_b, self.size_b)) if words else ():
            ids = np.array(ids, np.int32)
            ends = np.cumsum(size[ids])
            at = np.minimum(np.searchsorted(ends, upto), len(ids) - 1)
            if b"".join(table[ids].tolist()) != b" " + text.encode() or not np.array_equal(ends[at], upto):
                return out | {w: self._one(w) for w in words}
            raw, at = ids.tobytes(), [0, *(4 * at + 4).tolist()]
            cut.append([raw[i:k] for i, k in zip(at, at[1:], strict=False)])
        return out | {w: (x, y, True) for w, x, y in zip(words, *cut, strict=True)} if words else out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, of B, the number of each for each text, and whether they spell it; a text that they do not spell has none.

        A single space between two other characters that are no white space is a seam for both, so the words between are encoded once.
        """
        a, b, ok, known, missing, whole = [], [], [], self.known, set(), {}
        if len(known) > self.most or self.held > 50 * self.most:
            known.clear()
            self.held = 0
        split = [t.split(" ") for t in texts]
        for k, words in enumerate(split):
            new = set(words).difference(known)
            if not self.seams or any(not w or w[0].isspace() or w[-1].isspace() for w in new):
                whole[k] = self._one(texts[k])
            else:
                missing |= new
        known |= self._learn(list(missing))
        self.held += sum(map(len, missing))
        for k, words in enumerate(split):
            of_a, of_b, good = zip(*map(known.get, words), strict=True) if k not in whole else zip(whole[k], strict=True)
            ok.append(all(good))
            a.append(b"".join(of_a) if ok[-1] else b"")
            b.append(b"".join(of_b) if ok[-1] else b"")
        n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (a, b))
        return *(np.frombuffer(b"".join(ids), np.int32).astype(np.int64) for ids in (a, b)), n_a, n_b, np.array(ok)


def _table(of: dict[int, bytes]) -> np.ndarray:
    out = np.full(max(of) + 1, b"", object)
    for i, b in of.items():
        out[i] = b
    return out


def diagonal(ends_a: np.ndarray, ends_b: np.ndarray, d: int) -> tuple[int, int]:
    """How many ends of A and of B are the first ``d`` of both, A before B; an equal pair is kept together, so it may be one more."""
    low, high = max(0, d - len(ends_b)), min(d, len(ends_a))
    while low < high:
        i = (low + high) // 2
        if ends_a[i] <= ends_b[d - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, d - low
    return i, j + int(i > 0 and j < len(ends_b) and ends_a[i - 1] == ends_b[j])


def pieces(ends_a: np.ndarray, ends_b: np.ndarray, steps: int) -> list[tuple[int, int, int, int]]:
    """The merge path in pieces of ``steps`` ends: the ranges of A and of B of each."""
    at = [(0, 0), *(diagonal(ends_a, ends_b, d) for d in range(steps, len(ends_a) + len(ends_b), steps)), (len(ends_a), len(ends_b))]
    return [(i, k, j, m) for (i, j), (k, m) in zip(at, at[1:], strict=False) if (i, j) != (k, m)]


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of A and of B, and the ends that are common. The last group is open if no common end closes it."""
    at = np.searchsorted(ends_b, ends_a)
    hit = np.zeros(len(ends_a), bool)
    inside = at < len(ends_b)
    hit[inside] = ends_b[at[inside]] == ends_a[inside]
    hit_b = np.zeros(len(ends_b), bool)
    hit_b[at[hit]] = True
    return np.cumsum(hit) - hit, np.cumsum(hit_b) - hit_b, ends_a[hit]


def links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, owner: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id pair, times) of all pairs of tokens of a group, sorted; ``owner`` is the document of each group.

    Groups of over 4,096 pairs are reduced to their distinct ids first, and no more than about ``block`` pairs stand in memory at once.
    """
    n_a, n_b = np.bincount(group_a, minlength=len(owner)), np.bincount(group_b, minlength=len(owner))
    start_b, large = np.cumsum(n_b) - n_b, n_a * n_b > 4096
    keys, times = [], []

    def add(key: np.ndarray, n: np.ndarray | None) -> None:
        key, count = _counted(key, n)
        keys.append(key)
        times.append(count)

    each = np.where(large[group_a], 0, n_b[group_a])
    upto = np.concatenate([[0], np.cumsum(each)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + block, "right")) - 1)
        n = each[lo:hi]
        inner = np.arange(upto[hi] - upto[lo]) - np.repeat(upto[lo:hi] - upto[lo], n)
        key = (np.repeat(owner[group_a[lo:hi]] << 33 | a[lo:hi] << SHIFT, n)) | b[np.repeat(start_b[group_a[lo:hi]], n) + inner]
        add(key, None)
        lo = hi
    for g in np.flatnonzero(large):
        ua, ca = np.unique(a[np.searchsorted(group_a, g) : np.searchsorted(group_a, g, "right")], return_counts=True)
        ub, cb = np.unique(b[start_b[g] : start_b[g] + n_b[g]], return_counts=True)
        width = max(1, block // len(ub))
        for lo in range(0, len(ua), width):
            add((owner[g] << 33 | ua[lo : lo + width, None] << SHIFT | ub[None, :]).ravel(), (ca[lo : lo + width, None] * cb[None, :]).ravel())
    key, n = _counted(np.concatenate(keys), np.concatenate(times)) if len(keys) > 1 else (keys[0], times[0]) if keys else (np.zeros(0, np.int64),) * 2
    return key >> 33, key & ((1 << 33) - 1), n


def _counted(key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there, or the sums of ``n``."""
    if n is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def written(shown: np.ndarray, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> list[str]:
    """The tokens as they are written, group by group; ``last`` tells the groups that nothing follows."""
    n_a, n_b = np.bincount(group_a, minlength=len(last)), np.bincount(group_b, minlength=len(last))
    before_a, before_b = np.cumsum(n_a), np.cumsum(n_b)
    out = np.empty(len(a) + len(b), np.int64)
    i, j = np.arange(len(a)), np.arange(len(b))
    out[i + (before_b - n_b)[group_a]] = a * 4 + (i == before_a[group_a] - 1)
    out[j + before_a[group_b]] = b * 4 + np.where(j == before_b[group_b] - 1, 2 + last[group_b], 0)
    return shown[out].tolist()


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def _align(paths: tuple[str, str], steps: int, part: int, keep: bool):
    """Texts to finished documents, and the open pieces of those with a longer path."""
    names = [c.split()[0] for c in f"{_DOCUMENT}, {_OPEN}".split(", ")]

    def batch(done: dict, opened: dict) -> Iterator[pa.RecordBatch]:
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "sha256": pa.string(), "groups": pa.string(), "piece": pa.int32(), "ok": pa.bool_()} | {c: pa.int64() for c in ("n_a", "n_b", "n_groups", "n_links", "start_a", "start_b")}
        kinds |= {c: pa.list_(pa.int64()) for c in ("pairs", "times")} | {c: pa.binary() for c in ("ids_a", "ids_b")}
        for found in (done, opened):
            n = len(found["row"]) if found else 0
            if n:
                yield pa.RecordBatch.from_arrays([found[c] if isinstance(found.get(c), pa.Array) else pa.array(found[c], kinds[c]) if c in found else pa.nulls(n, kinds[c]) for c in names], names=names)

    def whole(pair: Pair, rows: list[tuple[int, int | None, str]]) -> Iterator[pa.RecordBatch]:
        """Texts of one part each."""
        a, b, n_a, n_b, _ = pair.encode([t for _, _, t in rows])
        long = n_a + n_b > steps
        if long.any():
            at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            for k in np.flatnonzero(long):
                yield from batch({}, cut(pair, *rows[k][:2], 0, True, a[at_a[k] : at_a[k] + n_a[k]], b[at_b[k] : at_b[k] + n_b[k]]))
            a, b, rows = a[np.repeat(~long, n_a)], b[np.repeat(~long, n_b)], [r for r, x in zip(rows, long, strict=True) if not x]
            n_a, n_b = n_a[~long], n_b[~long]
        ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        group_a, group_b, cuts = merge(ends_a, ends_b)
        stop = np.concatenate([[0], ends_a])[np.cumsum(n_a)]  # where the bytes of each text end
        owner = np.searchsorted(stop, cuts)
        doc, key, times = links(a, group_a, b, group_b, owner)
        of_doc = lambda values: np.bincount(owner, values, minlength=len(rows)).astype(np.int64)
        text, total, texts = written(pair.shown, a, group_a, b, group_b, np.isin(cuts, stop)), n_a + n_b, []
        for end, n in zip(np.cumsum(total), total, strict=True):
            texts.append("".join(text[end - n : end]))
        upto = np.cumsum(np.bincount(doc, minlength=len(rows)))
        yield from batch({
            "row": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "n_a": n_a, "n_b": n_b, "n_groups": of_doc(None), "n_links": of_doc(np.bincount(group_a, minlength=len(cuts)) * np.bincount(group_b, minlength=len(cuts))),
            "sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], "groups": texts if keep else [None] * len(rows), "pairs": _lists(key, upto, pa.int64()), "times": _lists(times, upto, pa.int64()),
        }, {})

    def cut(pair: Pair, row: int, doc_id: int | None, first: int, ok: bool, a: np.ndarray, b: np.ndarray) -> dict:
        """The pieces of one part of a text, numbered from ``first``."""
        ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        ranges = pieces(ends_a, ends_b, steps) if ok else [(0, 0, 0, 0)]
        n = len(ranges)
        cells = {"start_a": [int(ends_a[i - 1]) if i else 0 for i, *_ in ranges], "start_b": [int(ends_b[j - 1]) if j else 0 for _, _, j, _ in ranges]}
        cells |= {"ids_a": [a[i:k].astype(pair.kind).tobytes() for i, k, _, _ in ranges], "ids_b": [b[j:m].astype(pair.kind).tobytes() for _, _, j, m in ranges]}
        return {"row": [row] * n, "doc_id": [doc_id] * n, "piece": list(range(first, first + n)), "ok": [ok] * n} | cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of_process(*paths)
        for rows in batches:
            held, size = [], 0
            for row, doc_id, text in zip(*(rows.column(k) for k in range(3)), strict=True):
                row, doc_id, text = row.as_py(), doc_id.as_py(), text.as_py() or ""
                if len(text) > part and len(several := pair.parts(text, part)) > 1:
                    first = 0
                    for one in several:
                        a, b, _, _, ok = pair.encode([one])
                        opened = cut(pair, row, doc_id, first, bool(ok[0]), a, b)
                        first += len(opened["row"])
                        yield from batch({}, opened)
                    continue
                held.append((row, doc_id, text))
                size += len(text)
                if size > 1 << 19:
                    yield from whole(pair, held)
                    held, size = [], 0
            if held:
                yield from whole(pair, held)

    return run


def _merge_pieces(paths: tuple[str, str]):
    """Open pieces to the groups inside them and what stands open at their edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Pair.of_process(*paths)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                a, b = (np.frombuffer(x, pair.kind).astype(np.int64) for x in (r.ids_a, r.ids_b))
                group_a, group_b, cuts = merge(r.start_a + np.cumsum(pair.size_a[a]), r.start_b + np.cumsum(pair.size_b[b]))
                n = len(cuts)
                inner = [slice(*np.searchsorted(g, [1, max(n, 1)])) for g in (group_a, group_b)]
                head, tail = [x[g == 0] for x, g in ((a, group_a), (b, group_b))], [x[g >= max(n, 1)] for x, g in ((a, group_a), (b, group_b))]
                at = (a[inner[0]], group_a[inner[0]] - 1, b[inner[1]], group_b[inner[1]] - 1)
                groups = max(n - 1, 0)
                _, key, times = links(*at, np.zeros(groups, np.int64))
                text = "".join(written(pair.shown, *at, np.zeros(groups, np.int64)))
                out.append((r.row, r.doc_id, r.piece, r.ok, len(a), len(b), groups, int(times.sum()), n > 0, *head, *tail, text, key, times))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MERGED.split(", ")])

    return run


def _stitch(paths: tuple[str, str], keep: bool):
    """The pieces of one document to its row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pair, frame = Pair.of_process(*paths), frame.sort_values("piece")
        row, doc_id = frame["row"].iloc[0], frame["doc_id"].iloc[0]
        names = [c.split()[0] for c in _DOCUMENT.split(", ")]
        if not frame["ok"].all():
            return pd.DataFrame([(row, doc_id, 0, 0, 0, 0, "", "" if keep else None, [], [])], columns=names)
        n_groups, n_links, digest, texts, keys, times, held_a, held_b, sep = 0, 0, hashlib.sha256(), [], [], [], [], [], ""

        def take(text: str) -> None:
            digest.update(text.encode())
            if keep:
                texts.append(text)

        for r in frame.itertuples(index=False):
            held_a.append(r.head_a)
            held_b.append(r.head_b)
            if not r.closed:
                continue
            a, b = np.concatenate(held_a).astype(np.int64), np.concatenate(held_b).astype(np.int64)
            at = (a, np.zeros(len(a), np.int64), b, np.zeros(len(b), np.int64))
            _, key, n = links(*at, np.zeros(1, np.int64))
            take(sep + "".join(written(pair.shown, *at, np.ones(1, np.int64))))
            inner = r.groups[:-1]
            if inner:
                take(";" + inner)
            sep = ";"
            n_groups += 1 + r.n_groups
            n_links += len(a) * len(b) + r.n_links
            keys += [key, r.pairs]
            times += [n, r.times]
            held_a, held_b = [r.tail_a], [r.tail_b]
        key, n = _counted(np.concatenate(keys).astype(np.int64), np.concatenate(times).astype(np.int64))
        return pd.DataFrame([(row, doc_id, int(frame["n_a"].sum()), int(frame["n_b"].sum()), n_groups, n_links, digest.hexdigest(), "".join(texts) if keep else None, key, n)], columns=names)

    return run


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, steps: int = 16_384, part: int = 1 << 16, keep_groups: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): numbers of tokens, groups and links, the groups' sha256 (and ``groups`` itself, if kept), and its id pairs with how often each is linked."""
    paths = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), "text")
    found = staged(rows.mapInArrow(_align(paths, steps, part, keep_groups), f"{_DOCUMENT}, {_OPEN}"), "aligned", compression="zstd", **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#pairs.list.element": "false"})
    documents = [c.split()[0] for c in _DOCUMENT.split(", ")]
    opened = found.where("piece is not null").select("row", "doc_id", *[c.split()[0] for c in _OPEN.split(", ")])
    merged = opened.repartition(slices(docs.sparkSession), "row", "piece").mapInPandas(_merge_pieces(paths), _MERGED)
    stitched = merged.groupBy("row").applyInPandas(_stitch(paths, keep_groups), _DOCUMENT)
    return found.where("piece is null").select(documents).unionByName(staged(stitched, "stitched"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents ids are linked, and whether no other id of B is linked to this one of A in more."""
    counts = staged(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")), "pairs")
    a = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("highest"))  # a row for each id of A at most
    return counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = 1_000_000) -> DataFrame:
    """(row, n_best, count_sum) of the documents that have links."""
    least = (counts.agg(F.sum("documents")).first()[0] or 0) // frequent
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = counts.where(F.col("documents") > least)  # fewer than ``frequent`` rows
    sums = lambda x: x.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("documents") * F.col("times")).alias("count_sum"))
    most = sums(linked.join(F.broadcast(hot), "pair"))
    rare = sums(linked.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(counts.where(F.col("documents") <= least), "pair"))
    return most.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sums = with_counts(aligned, staged(pair_counts(aligned), "counts"))
    return aligned.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("sha256").alias("groups_sha256")
    )


QUERIES = {"op11_token_align": op11_token_align}
