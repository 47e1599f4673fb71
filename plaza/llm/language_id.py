"""Language identification by segmentation-marginalised unigrams.

The vocabulary of a public tokenizer (its pieces as bytes, a word start as one space) is fixed. A language is a
probability for each piece, and a word's probability is the sum over all its segmentations into pieces, by the forward
algorithm. Training is expectation maximisation with forward-backward counts over a table (language, word, count), which
Spark builds from a bounded sample: about ``per_language`` training documents of each language, chosen by a hash of
doc_id. The table, the expected counts and the sums are Spark jobs; only the model (pieces x languages) reaches the driver.
Texts are scored whole, in slices of bounded size that are cut between words: the distinct words of a slice are scored
together, without a Python loop over words, and verdicts on words are kept between slices.

Words are runs of ASCII letters (lower-cased) and non-ASCII bytes, of any length; all pieces of the vocabulary count and
no segmentation is left out. The score is the posterior of the predicted language under equal priors.

Cases: a null text or one without a letter is ``und`` with score 0; without training rows every text is ``und``; ties go
to the language that sorts first; rows with a null lang are predicted but not learned from; repeated rows are predicted
alike; an empty table gives an empty result; a null doc_id is not held out and not learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaza.llm import textbytes as tb
from plaza.llm.shared import staged

_SLICE = 1 << 19
_GIANT = 1 << 16
_KNOWN = 200_000
_FLOOR = 1e-8
_WORDS = "lang string, word binary, n bigint"
_SCORED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def vocabulary(path: str | None = None) -> list[bytes]:
    """The pieces of a sentencepiece model, word starts as a space, without special pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(found - {b""})


class Segmenter:
    """Finds all pieces in words by a trie and sums over all segmentations of the words, in logarithms.

    Piece ids are places in ``pieces``; ``size`` stands for a single byte that is no piece.
    """

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=1)
        children: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = children[node][byte]
            piece_at[node] = i
        # Edges of the trie in ascending order of (node, byte).
        flat = sorted((node << 8 | byte, to) for node, row in enumerate(children) for byte, to in row.items())
        self.edges = np.array([e for e, _ in flat] or [-1], np.int64)
        self.targets = np.array([t for _, t in flat] or [0], np.int64)
        self.piece_at = np.array(piece_at, np.int64)

    def matches(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of each piece in ``data``; a piece that starts at byte i ends at ``ends[i]`` at the latest."""
        at, node, out = np.arange(len(data)), np.zeros(len(data), np.int64), []
        for k in range(self.longest):
            inside = at + k < ends[at]
            at, node = at[inside], node[inside]
            if not len(at):
                break
            key = node << 8 | data[at + k]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[place] == key
            node = self.targets[place]
            piece = np.where(found, self.piece_at[node], -1)
            if k == 0:
                piece = np.where(piece < 0, self.size, piece)
            some = piece >= 0
            out.append((at[some], np.full(int(some.sum()), k + 1), piece[some]))
            at, node = at[found], node[found]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    @staticmethod
    def _sums(word: np.ndarray, end: np.ndarray, length: np.ndarray, logs: np.ndarray, base: np.ndarray, longest: int) -> np.ndarray:
        """Log sums over the segmentations of each beginning of each word: row ``base[w] + j`` is for the first j bytes of word w.

        Words are numbered by falling length, so those that have a byte j are the first ones; each has a match that ends there.
        """
        order = np.lexsort((word, end))
        word, end, length, logs = word[order], end[order], length[order], logs[order]
        source, target = base[word] + end - length, base[word] + end
        cuts = np.searchsorted(end, np.arange(1, longest + 2))
        out = np.zeros((int(base[-1]) if len(base) else 0, logs.shape[1]))
        first = np.flatnonzero(_starts(target))
        heads = np.searchsorted(first, cuts)
        for j in range(longest):
            lo, hi = cuts[j], cuts[j + 1]
            x = out[source[lo:hi]] + logs[lo:hi]
            at = first[heads[j] : heads[j + 1]] - lo
            most = np.maximum.reduceat(x, at, axis=0)
            times = np.diff(np.append(at, hi - lo))
            out[target[lo + at]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, times, axis=0)), at, axis=0))
        return out

    def _lattice(self, data: np.ndarray, widths: np.ndarray):
        """Word, start in the word, length and id of all pieces of words of falling ``widths`` that stand one after another in ``data``."""
        last = np.cumsum(widths)
        start, length, piece = self.matches(data, np.repeat(last, widths))
        word = np.searchsorted(last, start, "right")
        return word, start - (last - widths)[word], length, piece, np.concatenate([[0], np.cumsum(widths + 1)])

    def forward(self, data: np.ndarray, widths: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The log probability (words x languages) of each word, summed over all its segmentations; ``logp`` has a row for each id."""
        word, start, length, piece, base = self._lattice(data, widths)
        return self._sums(word, start + length, length, logp[piece], base, int(widths[0]))[base[:-1] + widths]

    def forward_giant(self, data: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """The same for a single word of any length, which is walked in blocks with the sums of the last ``longest`` bytes."""
        held = np.zeros((1, logp.shape[1]))  # the sums at the last bytes before the block, the nearest last
        for lo in range(0, len(data), 4096):
            hi, early = min(len(data), lo + 4096), lo - len(held) + 1
            start, length, piece = self.matches(data[early:hi], np.full(hi - early, hi - early))
            new = start + length > lo - early
            start, length, piece = start[new], length[new], piece[new]
            order = np.argsort(start + length, kind="stable")
            source, logs = start[order], logp[piece[order]]
            cuts = np.searchsorted((start + length)[order], np.arange(lo - early + 1, hi - early + 2))
            out = np.concatenate([held, np.zeros((hi - lo, logp.shape[1]))])
            for j in range(hi - lo):
                x = out[source[cuts[j] : cuts[j + 1]]] + logs[cuts[j] : cuts[j + 1]]
                most = x.max(axis=0)
                out[len(held) + j] = most + np.log(np.exp(x - most).sum(axis=0))
            held = out[-self.longest :]
        return held[-1]

    def expected(self, data: np.ndarray, widths: np.ndarray, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words with ``counts``, for one language (``logp`` has one column)."""
        word, start, length, piece, base = self._lattice(data, widths)
        logs, end = logp[piece], start + length
        ahead = self._sums(word, end, length, logs, base, int(widths[0]))[:, 0]
        back = self._sums(word, widths[word] - start, length, logs, base, int(widths[0]))[:, 0]  # the words read backwards
        share = ahead[base[word] + start] + logs[:, 0] + back[base[word] + widths[word] - end] - ahead[base[word] + widths[word]]
        return np.bincount(piece, np.exp(share) * counts[word], self.size + 1)


def _starts(values: np.ndarray) -> np.ndarray:
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return first


def _letters() -> np.ndarray:
    lut = tb.alnum_class()
    lut[0x30:0x3A] = False
    return lut


def pieces_of(data: np.ndarray, offsets: np.ndarray, most: int = _SLICE) -> Iterator[tuple[int, int]]:
    return tb.cut(data, offsets, _letters(), most)


def _spaced(part: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The words one after another, each after a space."""
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    ends = np.cumsum(lengths)
    source = np.repeat(starts - ends + lengths, lengths) + np.arange(int(lengths.sum()))
    out[np.arange(len(source)) + np.repeat(np.arange(len(lengths)), lengths) + 1] = part[source]
    return out


class Scorer:
    """Log probabilities of the words of whole texts in each language. Verdicts on words are kept between slices while they are few."""

    def __init__(self, seg: Segmenter, logp: np.ndarray):
        self.seg, self.logp = seg, logp
        self._forget()

    def _forget(self) -> None:
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros((0, self.logp.shape[1]))

    def _learn(self, part: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        if len(self.keys) > _KNOWN:
            self._forget()
        new = np.zeros((len(keys), self.logp.shape[1]))
        order = np.argsort(-lengths, kind="stable")
        for k in np.flatnonzero(lengths >= _GIANT):
            new[k] = self.seg.forward_giant(np.concatenate([[np.uint8(0x20)], part[starts[k] : starts[k] + lengths[k]]]), self.logp)
        order = order[lengths[order] < _GIANT]
        for lo, hi in tb.chunks(np.concatenate([[0], np.cumsum(lengths[order])]), 1 << 17):
            at = order[lo:hi]
            new[at] = self.seg.forward(_spaced(part, starts[at], lengths[at]), lengths[at] + 1, self.logp)
        keys, logs = np.concatenate([self.keys, keys]), np.concatenate([self.logs, new])
        order = np.argsort(keys)
        self.keys, self.logs = keys[order], logs[order]

    def __call__(self, part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x languages: the summed logarithms of the words of each row."""
        starts, ends, rows = tb.words(part, offsets, _letters())
        if not len(starts):
            return np.zeros((len(offsets) - 1, self.logp.shape[1]))
        keys, first, index = np.unique(tb.word_hashes(part, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) > _KNOWN:
                new[:] = True
            self._learn(part, keys[new], starts[first[new]], (ends - starts)[first[new]])
        logs = self.logs[np.searchsorted(self.keys, keys)][index]
        return np.stack([np.bincount(rows, logs[:, x], len(offsets) - 1) for x in range(logs.shape[1])], axis=1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs = b.column(0).dictionary_encode()
        codes, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
        data, offsets = tb.flat(b.column(1))
        for at, end in pieces_of(data, offsets):
            part, local, row = tb.within(data, offsets, at, end)
            starts, ends, rows = tb.words(part, local, _letters())
            if not len(starts):
                continue
            _, first, index = np.unique(tb.word_hashes(part, starts, ends), return_index=True, return_inverse=True)
            both, times = np.unique(codes[row + rows].astype(np.int64) * len(first) + index, return_counts=True)
            code, word = both // len(first), first[both % len(first)]
            raw = [part[s:e].tobytes() for s, e in zip(starts[word].tolist(), ends[word].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[c] for c in code]), pa.array(raw, pa.binary()), pa.array(times.astype(np.int64))], names=["lang", "word", "n"])


def _expect(pieces: list[bytes], model: dict[str, np.ndarray]):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(pieces)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, counts = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy().astype(float)
            part, offsets = tb.flat(b.column(1))
            lengths = np.diff(offsets)
            for lang in set(langs):
                mine = np.flatnonzero(langs == lang)
                mine = mine[np.argsort(-lengths[mine], kind="stable")]
                for lo, hi in tb.chunks(np.concatenate([[0], np.cumsum(lengths[mine])]), 1 << 17):
                    at = mine[lo:hi]
                    got = seg.expected(_spaced(part, offsets[at], lengths[at]), lengths[at] + 1, np.log(model[lang])[:, None], counts[at])
                    sums[lang] = sums.get(lang, 0) + got
        for lang, got in sums.items():
            some = np.flatnonzero(got[: seg.size])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(got[some])], names=["lang", "piece", "n"])

    return expect


def with_held_out(docs: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """Adds held_out: crc32 of doc_id as text leaves ``remainder``."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False)))


def train(labelled: DataFrame, pieces: list[bytes], per_language: int = 2000, rounds: int = 3) -> dict[str, np.ndarray]:
    """Language -> piece probabilities, from ``labelled`` (doc_id, text, lang)."""
    labelled = labelled.where("lang is not null and text is not null and doc_id is not null")
    share = labelled.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    chosen = labelled.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))  # one row for each language
    table = staged(chosen.select("lang", "text").mapInArrow(_count_words, _WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    model = {r[0]: np.append(np.full(len(pieces), 1.0 / len(pieces)), _FLOOR) for r in table.select("lang").distinct().collect()}
    for _ in range(rounds):
        got = table.mapInArrow(_expect(pieces, model), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        for lang, part in got.groupby("lang"):
            p = np.full(len(pieces), 0.02)
            p[part["piece"].to_numpy()] += part["n"].to_numpy()
            model[lang] = np.append(p / p.sum(), _FLOOR)
    return model


def _scorer(pieces: list[bytes], model: dict[str, np.ndarray]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(model)
        scorer = Scorer(Segmenter(pieces), np.log(np.stack([model[x] for x in names], axis=1))) if names else None
        ascii_letters = _letters()
        ascii_letters[0x80:] = False
        for b in batches:
            texts = b.column(2)
            data, offsets = tb.flat(texts)
            total, letter = np.zeros((b.num_rows, len(names))), np.zeros(b.num_rows, bool)
            for at, end in pieces_of(data, offsets) if names else ():
                part, local, row = tb.within(data, offsets, at, end)
                total[row : row + len(local) - 1] += scorer(part, local)
                seen = np.concatenate([[0], np.cumsum(ascii_letters[part])])
                letter[row : row + len(local) - 1] |= seen[local[1:]] > seen[local[:-1]]
            for i in np.flatnonzero(~letter) if names else ():
                letter[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
            best = total.argmax(axis=1) if names else np.zeros(b.num_rows, int)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if names else np.zeros(b.num_rows)
            pred = [names[x] if ok else "und" for x, ok in zip(best, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.where(letter, sure, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return score


def identify(docs: DataFrame, model: dict[str, np.ndarray], pieces: list[bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, held_out, text)."""
    return docs.select(F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(_scorer(pieces, model), _SCORED)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), 4, 2)
    pieces = vocabulary()
    return identify(docs, train(docs.where("not held_out"), pieces), pieces)


QUERIES = {"op4_language_id": op4_language_id}
