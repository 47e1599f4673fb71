"""Plain-Python references that the operators are held against."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return frozenset(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_duplicates(texts, threshold=0.8):
    """doc_id -> (class, links), by all pairs."""
    sets = {d: shingles(t) for d, t in texts.items()}
    ids, parent, links = sorted(sets), {d: d for d in sets}, Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (find(d), links[d]) for d in ids}


def contamination(texts, items, window=10):
    """doc_id -> (n_words, n_hit, items)."""
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if got := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), found)
    return out


def without_repeats(texts, least=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept sha256), documents in ascending order."""
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone, mine = np.zeros(len(b) + 1, bool), set()
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = True
            mine.add(b[i : i + least])
        seen |= mine
        gone = gone[: len(b)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out
