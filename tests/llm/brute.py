"""Brute-force versions that the tests compare with."""

import collections
import re

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = SPACE_WORDS.findall((text or "").translate(_LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def jaccard_components(docs):
    """``doc_id -> (set size, component)`` for ``(doc_id, text)`` rows; every pair that shares a shingle is compared."""
    sets = {d: shingle_set(t) for d, t in docs}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for k in s:
            where[k].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(o for k in s for o in where[k] if o < d)
        for o, i in shared.items():
            if 100 * i >= 80 * (len(s) + len(sets[o]) - i):
                a, b = root(o), root(d)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def without_repeats(docs, length=100):
    """``doc_id -> (kept bytes, removed, spans)`` for ``(doc_id, text)`` rows."""
    data = sorted((d, (t or "").encode()) for d, t in docs)
    first, out = {}, {}
    for d, t in data:
        for i in range(len(t) - length + 1):
            first.setdefault(t[i:i + length], (d, i))
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i:i + length]] < (d, i):
                gone[i:i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone), spans)
    return out
