"""Plain single-process versions of what the operators' queries return, written from their definitions."""

from __future__ import annotations

import hashlib
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def alnum(text: str | None) -> list[str]:
    return ALNUM.findall((text or "").translate(LOWER))


def decontaminate(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = alnum(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, names = set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def license_base(docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    out = []
    for doc, text in docs:
        w = alnum(text)
        at, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def repeated_words(docs, n=50):
    """op5: words covered by an n-word window whose sequence also starts in a document with a smaller doc_id."""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def repeated_bytes(docs, n=100):
    """op7: bytes covered by an n-byte string that also starts earlier (smaller doc_id, or same document, earlier)."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - n + 1):
            key = b[i : i + n]
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < (d, i):
                gone[i : i + n] = [True] * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def shingles(text: str | None, n=5) -> set[tuple[str, ...]]:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def jaccard_components(docs, per_cent=80):
    sets = [(d, shingles(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= per_cent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]
