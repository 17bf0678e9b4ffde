"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document; a word is removed if a window that covers it also starts in a
document with a smaller doc_id. Windows are judged on the input, not on what is left.

1. *Confirm recurring passages.* Each window is filed under its minimiser: the leftmost smallest hash among its
   ``anchor``-word grams. Equal windows have equal minimisers, and neighbouring windows mostly share one, so the windows
   travel as runs: one row per (block of documents, shard of anchors) holds packed arrays of anchors, run bounds and
   window hashes. A shard sorts its windows by (anchor, window hash), takes the smallest document of each and returns,
   per document, the runs of windows that a smaller document also has. Equality is of two independent 64-bit hashes.
2. *Compile sharded automata.* Documents and their recurring passages meet by document; each batch of documents is a
   shard. A passage is the word sequence of a run of recurring windows, with the largest of its windows' first
   documents as source. pyahocorasick compiles the shard's distinct passages over word ids.
3. *Stream all documents.* Every document runs through its shard's automaton, which locates every occurrence of every
   passage; an occurrence counts in documents after the passage's source.

Nothing grows with a key: a frequent passage is one window per block, and a shard's work is linear in its windows. The
many different windows of a frequent anchor (``hot_anchors``) are spread over the shards by their own hashes.

Defined results: a null or short text loses nothing; rows that repeat a doc_id are judged as one document's rows (none
is smaller than the other); a null doc_id is judged as the largest (2**63 - 1, which no document may have); further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import apart, cut, lean, parts_for, pieces, text_bytes, total_bytes, with_columns, words

WINDOW = 50
ANCHOR = 10
#: Bytes of text behind one shard of windows.
SHARD_BYTES = 3 << 20
LAST = np.int64(2**63 - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: One of how many documents is looked at for frequent anchors; how many different windows make one there (64 times as
#: many would fill about half a shard); how many of them are told to the tasks at most (8 bytes each).
HOT_SHARE, HOT_LEAST, HOT_MOST = 64, 4096, 50_000
#: Windows that a map task holds before it sends them on.
BUFFER = 1 << 17
PACKED = "shard int, kind int, anchors binary, hashes binary, docs binary, starts binary, first binary, ids binary, keys binary"
SCHEMA = "doc_id long, text string, n_words long, removed array<int>"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int, mult: np.uint64) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes, by doubling: exact polynomials modulo 2**64."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = np.zeros(m, np.uint64), 0, mult, h
    size = 1
    while True:
        if n & size:
            out = out * power + width[done : done + m]
            done += size
        if size * 2 > n:
            break
        width = width[: len(width) - size] * power + width[size:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        size *= 2
    return mix(out)


def sliding_least(g: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive values."""
    m = len(g) - w + 1
    size = 1
    while size * 2 <= w:
        g = np.minimum(g[: len(g) - size], g[size:])
        size *= 2
    return np.minimum(g[:m], g[w - size : w - size + m])


def minimisers(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of each w consecutive values."""
    low = np.uint64(0xFFFFFFFF)
    g = np.asarray(g).astype(np.uint64, copy=False)
    best = (sliding_least((g & ~low) | np.arange(len(g), dtype=np.uint64), w) & low).astype(np.int32)
    # the upper halves decide, but where they tie
    return best if np.array_equal(g[best], sliding_least(g, w)) else _minimisers_by_position(g, w)


def _minimisers_by_position(g: np.ndarray, w: int) -> np.ndarray:
    m = len(g) - w + 1
    size = 1
    best = np.arange(len(g), dtype=np.int32)
    while size * 2 <= w:
        a, b = best[: len(best) - size], best[size:]
        best = np.where(g[b] < g[a], b, a)
        size *= 2
    a, b = best[:m], best[w - size : w - size + m]
    return np.where(g[b] < g[a], b, a)


class WordHashes:
    """64-bit hashes of words, remembered per piece of text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, split: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for w in set(split).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, split), np.uint64, len(split))


def hot_anchors(documents: DataFrame, of: Callable[[bytes], tuple[np.ndarray, np.ndarray]], share: int = HOT_SHARE) -> np.ndarray:
    """Sorted hashes of the anchors that have many different contexts in one of ``share`` documents (chosen by doc_id): at
    most ``HOT_MOST``, those with the most. ``of`` gives a text's anchors and the hashes of what is filed under them;
    copies count once, as buffers settle them. This only decides which shard an anchor's windows go to, never what is
    found; an anchor that the sample misses is an ordinary one."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = text_bytes(b.column("text"))
            for lo, hi in pieces(sizes):
                found = [of(t) for t in texts[lo:hi] if t]
                if found:
                    a, h = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h)], names=["anchor", "context"])

    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    different = sample.mapInArrow(lean(pairs), "anchor long, context long").distinct()
    many = different.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST)
    rows = many.orderBy(F.desc("n"), "anchor").limit(HOT_MOST).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def is_hot(a: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(a), bool)
    return hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a


def _windows(documents: DataFrame, n_shards: int, window: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """Packed arrays, one row per buffer of windows and shard. A buffer settles the windows that several of its own
    documents have (kind 1: already confirmed, with their first document) and sends one of each kind on (kind 0), so a
    frequent passage reaches its shard once per buffer."""

    def pack(kind, a, h, d, s, first, ids, keys):
        shard = np.where(is_hot(a, hot), h, a) % np.uint64(n_shards)
        shard = shard.astype(np.uint16 if n_shards < 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")
        a, h, d, s, first, shard = a[order], h[order], d[order], s[order], first[order], shard[order]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            rows, index = np.unique(d[i:j], return_inverse=True)
            yield (
                int(shard[i]),
                kind,
                a[i:j].tobytes() if kind == 0 else b"",
                h[i:j].tobytes() if kind == 0 else b"",
                np.diff(index, prepend=0).astype("<i4").tobytes(),
                np.diff(s[i:j], prepend=0).astype("<i4").tobytes(),
                b"" if kind == 0 else np.diff(first[i:j], prepend=0).tobytes(),
                ids[rows].tobytes(),
                keys[rows].tobytes(),
            )

    def flush(kept, ids, keys):
        a, h, d, s = (np.concatenate(x) for x in zip(*kept, strict=True))
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        order = np.lexsort((ids[d], h))
        a, h, d, s = a[order], h[order], d[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
        first = ids[d][np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
        known = first < ids[d]
        out = []
        for kind, keep in ((0, ~known), (1, known)):
            at = np.flatnonzero(keep)
            at = at[np.lexsort((s[at], d[at]))]
            out += pack(kind, a[at], h[at], d[at], s[at], first[at], ids, keys)
        cols = zip(*out, strict=True)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=PACKED.replace(",", "").split()[::2]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kept, ids, keys, held = [], [], [], 0
        for b in batches:
            texts, sizes = text_bytes(b.column("text"))
            own = b.column("doc_id").fill_null(int(LAST)).to_pylist()
            text_keys = b.column("key").to_pylist()
            for i, t in enumerate(texts):
                if sizes[i] < 2 * window - 1 or len(split := words(t)) < window:
                    continue
                h = hashes(split)
                g = gram_hashes(h, anchor, _M1)
                full = gram_hashes(h, window, _M2)
                at = minimisers(g, window - anchor + 1)
                kept.append((g[at], full, np.full(len(full), len(ids), np.int32), np.arange(len(full), dtype=np.int32)))
                ids.append(own[i])
                keys.append(text_keys[i])
                held += len(full)
                if held >= BUFFER:
                    yield flush(kept, ids, keys)
                    kept, ids, keys, held = [], [], [], 0
        if kept:
            yield flush(kept, ids, keys)

    return documents.select("doc_id", "key", "text").mapInArrow(lean(run), PACKED)


def recurring(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, key, start, n, source: runs of n windows, from word ``start`` on, that also start in a smaller document;
    ``source`` is the largest of the windows' smallest documents. ``key`` tells rows of one doc_id apart by their text."""

    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        split = words(text)
        if len(split) < window:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        h = WordHashes()(split)
        g = gram_hashes(h, anchor, _M1)
        return g[minimisers(g, window - anchor + 1)], gram_hashes(h, window, _M2)

    n_shards = parts_for(total_bytes(documents), SHARD_BYTES)
    packed = _windows(documents, n_shards, window, anchor, hot_anchors(documents, of))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, h, d, k, s, done = [], [], [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                index = np.cumsum(np.frombuffer(r["docs"], "<i4"))
                doc, key = np.frombuffer(r["ids"], np.int64)[index], np.frombuffer(r["keys"], np.int64)[index]
                start = np.cumsum(np.frombuffer(r["starts"], "<i4")).astype(np.int32)
                if r["kind"]:
                    done.append((doc, key, start, np.cumsum(np.frombuffer(r["first"], np.int64))))
                    continue
                a.append(np.frombuffer(r["anchors"], np.uint64))
                h.append(np.frombuffer(r["hashes"], np.uint64))
                d.append(doc)
                k.append(key)
                s.append(start)
        if a:
            a, h, d, k, s = map(np.concatenate, (a, h, d, k, s))
            order = np.lexsort((d, h, a))
            new = np.ones(len(a), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])
            first = np.empty(len(a), np.int64)
            first[order] = d[order][np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
            keep = first < d
            done.append((d[keep], k[keep], s[keep], first[keep]))
        d, k, s, first = map(np.concatenate, zip(*done, strict=True))
        order = np.lexsort((s, k, d))
        d, k, s, first = d[order], k[order], s[order], first[order]
        at = np.flatnonzero(
            np.concatenate(([len(d) > 0], (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] - s[:-1] > 1)))[: len(d)]
        )
        last = np.append(at[1:], len(d)) - 1 if len(at) else at
        source = np.maximum.reduceat(first, at) if len(at) else first
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[at], mask=d[at] == LAST), pa.array(k[at]), pa.array(s[at]), pa.array(s[last] - s[at] + 1, pa.int32()), pa.array(source)],
            names=["doc_id", "key", "start", "n", "source"],
        )

    return packed.groupBy("shard").applyInArrow(lean(confirm), "doc_id long, key long, start int, n int, source long")


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Streams batches of (doc_id, text, passages, further columns) through the automaton of each shard of documents."""
    for b in batches:
        if not b.num_rows:
            continue
        texts, sizes = text_bytes(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        found = b.column("passages").to_pylist()
        counts = [len(words(t)) if t else 0 for t in texts]
        removed: list[list[int]] = [[] for _ in ids]
        with_passages = np.array([sizes[i] if found[i] else 0 for i in range(len(ids))])
        rows = np.flatnonzero(with_passages)
        for lo, hi in pieces(with_passages[rows], 1 << 22):
            shard = rows[lo:hi].tolist()
            vocab: dict[bytes, int] = {}
            split = {i: [vocab.setdefault(w, len(vocab)) for w in words(texts[i])] for i in shard}
            patterns: dict[tuple[int, ...], int] = {}
            for i in shard:
                for p in joined(found[i]):
                    key = tuple(split[i][p[0] : p[0] + p[1] + window - 1])
                    patterns[key] = min(patterns.get(key, p[2]), p[2])
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, source in patterns.items():
                automaton.add_word(key, (len(key), source))
            automaton.make_automaton()
            for i in shard:
                own = LAST if ids[i] is None else ids[i]
                spans = [(e - n + 1, e + 1) for e, (n, source) in automaton.iter(tuple(split[i])) if source < own]
                removed[i] = _merge(spans)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("text"),
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.list_(pa.int32())),
                *b.columns[3:],
            ],
            names=["doc_id", "text", "n_words", "removed", *b.schema.names[3:]],
        )


def joined(runs: list[dict]) -> list[tuple[int, int, int]]:
    """Runs of windows from several shards, as maximal passages (start, windows, source)."""
    out: list[list[int]] = []
    for start, n, source in sorted((r["start"], r["n"], r["source"]) for r in runs):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n - out[-1][0])
            out[-1][2] = max(out[-1][2], source)
        else:
            out.append([start, n, source])
    return [tuple(x) for x in out]


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _with_passages(documents: DataFrame, window: int, anchor: int, kept: Sequence[str] = ()) -> DataFrame:
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    runs = cut(recurring(table, window, anchor), "recurring")
    passages = runs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n", "source")).alias("passages"))
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text", *apart(kept)[0])
    out = rows.alias("d").join(passages.alias("p"), on, "left")
    return out.select("d.doc_id", "d.text", "p.passages", *(f"d.kept_{i}" for i in range(len(kept))))


def repeated_spans(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, kept: Sequence[str] = ()
) -> DataFrame:
    """doc_id, text, n_words, removed (flat [start, end) pairs of word positions) and the columns named in ``kept`` for
    every row of documents. A further column that is named like a result comes back as own_<name>."""
    rows = _with_passages(documents, window, anchor, kept)
    out = rows.mapInArrow(lean(lambda batches: _locate(batches, window)), with_columns(SCHEMA, rows, rows.columns[3:]))
    names = ["doc_id", "text", "n_words", "removed"]
    return out.select(*names, *apart(kept, *names)[1])


def digest_documents(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: as ``repeated_spans``, but only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _locate(batches, window):
            texts, _ = text_bytes(b.column("text"))
            gone = b.column("removed").to_pylist()
            kept = [hashlib.sha256(b" ".join(kept_words(t, g))).hexdigest() for t, g in zip(texts, gone, strict=True)]
            n = [sum(g[1::2]) - sum(g[::2]) for g in gone]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(n, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _with_passages(documents, window, anchor).mapInArrow(
        lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def kept_words(text: bytes | None, removed: list[int]) -> list[bytes]:
    split = words(text) if text else []
    for a, b in zip(removed[::2], removed[1::2], strict=True):
        split[a:b] = [None] * (b - a)
    return [w for w in split if w is not None]


def remaining_texts(
    documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, kept: Sequence[str] = ()
) -> DataFrame:
    """doc_id, text, n_removed and the columns named in ``kept`` for every row of documents: untouched texts stay as they
    are, others keep their words joined by one space. A further column that is named like a result comes back as
    own_<name>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _locate(batches, window):
            texts, _ = text_bytes(b.column("text"))
            gone = b.column("removed").to_pylist()
            out = [b" ".join(kept_words(t, g)) if g else t for t, g in zip(texts, gone, strict=True)]
            n = [sum(g[1::2]) - sum(g[::2]) for g in gone]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), *b.columns[4:]],
                names=["doc_id", "text", "n_removed", *b.schema.names[4:]],
            )

    rows = _with_passages(documents, window, anchor, kept)
    out = rows.mapInArrow(lean(run), with_columns("doc_id long, text string, n_removed long", rows, rows.columns[3:]))
    names = ["doc_id", "text", "n_removed"]
    return out.select(*names, *apart(kept, *names)[1])
