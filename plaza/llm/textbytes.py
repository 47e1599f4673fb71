"""Words and their hashes over the raw bytes of Arrow string columns, vectorised with numpy.

A *word* is a maximal run of bytes of a byte class. Its 64-bit hash is a difference of prefix sums of
``byte * BASE**i`` modulo 2**64, brought back to exponent zero and mixed; so all words of a batch are hashed
without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_POW: dict[int, np.ndarray] = {}


def alnum_class() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``: ASCII letters and digits and all non-ASCII."""
    lut = np.zeros(256, bool)
    lut[0x30:0x3A] = lut[0x41:0x5B] = lut[0x61:0x7B] = lut[0x80:] = True
    return lut


def lower_table() -> np.ndarray:
    """A to Z become a to z; other bytes stay."""
    lut = np.arange(256, dtype=np.uint8)
    lut[0x41:0x5B] += 32
    return lut


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows of a string column and the n + 1 offsets of the rows; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base**0 .. base**n`` modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _POW[base] = have
    return have


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = powers(len(data)), powers(len(data), pow(BASE, -1, 1 << 64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row of fewer words, but not none, is one shingle of them all."""
    step, out, at = np.uint64(0xD6E8FEB86659FD93), hashes[: max(0, len(hashes) - size + 1)].copy(), rows[: max(0, len(rows) - size + 1)]
    for j in range(1, size):
        out = out * step + hashes[j : len(hashes) - size + 1 + j]
    whole = rows[size - 1 :] == at if len(at) else np.zeros(0, bool)
    out, at = mix(out[whole]), at[whole]
    count = np.bincount(rows, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.cumsum(count) - count
        extra = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            more = count[few] > j
            extra[more] = extra[more] * step + hashes[first[few[more]] + j]
        extra = mix(extra + count[few].astype(np.uint64))
        out, at = np.concatenate([out, extra]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def cut(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes, cut between words or rows; only a longer word makes a longer range, which is then that word alone."""
    at, n = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    while at < n:
        end = min(n, at + most)
        if end < n:
            gaps = np.flatnonzero(~member[data[at:end]])
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            end = max(at + int(gaps[-1]) + 1 if len(gaps) else at, row)
            if end <= at:  # one word fills the range
                stop = int(offsets[np.searchsorted(offsets, at, "right")])
                end = at + most
                while end < stop and member[data[end]]:
                    more = np.flatnonzero(~member[data[end : min(stop, end + most)]])
                    end = end + int(more[0]) if len(more) else min(stop, end + most)
        yield at, end
        at = end


def within(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The lower-cased bytes of a range, the offsets of the rows in it, and its first row."""
    lo, hi = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
    return lower_table()[data[at:end]], np.clip(offsets[lo : hi + 1], at, end) - at, lo


def hashed_words(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each lower-cased word of letters and digits; long rows are worked in pieces."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, end in cut(data, offsets, alnum_class(), most):
        part, local, row = within(data, offsets, at, end)
        starts, ends, rows = words(part, local, alnum_class())
        hashes.append(word_hashes(part, starts, ends))
        owners.append(rows + row)
    return np.concatenate(hashes), np.concatenate(owners)


def least_shingles(texts: pa.Array, size: int = 5) -> np.ndarray:
    """The smallest hash of ``size`` consecutive words of each text, by which near copies mostly agree; 0 for no words."""
    data, offsets = flat(texts)
    least = np.zeros(len(texts), np.int64)
    for lo, hi in chunks(offsets, 1 << 20):
        h, rows = hashed_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        h, r = shingle_hashes(h, rows, hi - lo, size)
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            least[lo + r[first]] = np.minimum.reduceat(h, first).view(np.int64)
    return least
