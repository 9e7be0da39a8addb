"""Brute-force versions of the training-data operators, in plain Python, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def exact_groups(rows):
    """{(id, text): (keep_id, size)} keeping the largest id."""
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t), []).append(i)
    return {(i, t): (max((x for x in groups[ascii_lower(t)] if x is not None), default=None), len(groups[ascii_lower(t)])) for i, t in rows}


def shingles(text, n=5):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def near_groups(rows, least=0.8):
    """{id: smallest id of its connected group}."""
    s = {i: shingles(t) for i, t in rows}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and (s[a] == s[b] or (s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= least)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def removed_words(texts, window=35):
    """Per text the words that stay and the number that go."""
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(([x for x, g in zip(w, gone) if not g], sum(gone)))
    return out


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n
