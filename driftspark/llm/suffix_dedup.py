"""Suffix-array dedup of byte strings by external induced sorting.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same
document and an earlier start). Strings are judged on the input, not on what is left.

1. *Anchors.* Each string of ``length`` bytes is filed under its minimiser, the leftmost smallest hash among its
   ``ANCHOR``-byte grams; equal strings have equal minimisers at equal offsets. An anchor's context is everything that
   strings filed under it can cover. Anchors travel as hash and position with a hash of their context.
2. *Settled contexts.* Among occurrences of one anchor with one context, all but the first are covered completely. What
   is left of an anchor is one occurrence for each different context; where there are several, their texts are fetched.
3. *Sorting.* The texts of a shard of anchors, one after another, get a suffix array with common-prefix values, by
   induced sorting on disk (``Sorter``): classes of suffixes in queues, recursion on named substrings. Neighbours with a
   common prefix of ``length`` or more form groups, and every member but the earliest is covered.
4. Covered ranges meet their documents.

An anchor with very many occurrences is pre-aggregated in each buffer (one occurrence per context and buffer goes on).
The occurrences of anchors that a sample shows to be frequent are settled by context, over all shards. An anchor with
more than ``MOST`` different contexts is not sorted in one task: its strings are settled by their own hashes, likewise
over all shards, so no text or group grows with an anchor.

Defined results: a null or short text loses nothing; rows that repeat a doc_id are judged one after another by their
text's hash, and equal rows as one; a null doc_id is judged as the largest (2**63 - 1, which no document may have);
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import cut, lean, parts_for, text_bytes, total_bytes
from driftspark.llm.induced_sort import Sorter
from driftspark.llm.phrase_dedup import LAST, gram_hashes, hot_anchors, is_hot, minimisers, mix

LENGTH = 100
ANCHOR = 40
SHARD_BYTES = 8 << 20
#: Anchors that a map task holds before it sends them on, and bytes of contexts in one sorted text.
BUFFER = 1 << 17
SORT_BYTES = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Different contexts of one anchor that are sorted in one text.
MOST = 4096
ASK = "shard int, done boolean, anchors binary, contexts binary, docs binary, starts binary, ids binary, keys binary, sizes binary"
RANGES = "kind int, doc_id long, key long, start int, stop int, anchor long, at int"


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors (ascending), their hashes, and hashes of their contexts."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    g = gram_hashes(mix(raw + np.uint64(1)), ANCHOR, _M1)
    at = minimisers(g, length - ANCHOR + 1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]  # they ascend
    low = np.maximum(at - (length - ANCHOR), 0)
    high = np.minimum(at + length, len(raw))
    # prefix sums of a polynomial give the hash of any range
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(raw), _M2))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(raw + np.uint64(977)) * powers[:-1], dtype=np.uint64)))
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(raw), _INVERSE))), dtype=np.uint64)
    context = (sums[high] - sums[low]) * back[low]
    shape = (high - low).astype(np.uint64) << np.uint64(32) | (at - low).astype(np.uint64)
    return at, g[at], mix(context ^ mix(shape))


_INVERSE = np.uint64(pow(int(_M2), -1, 1 << 64))


def later(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether a row's place differs from that of the first row of its group (``first`` marks those)."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return np.logical_or.reduce([x != x[head] for x in place])


class _Buffer:
    """Occurrences in packed rows by shard. It keeps the first occurrence of each (anchor, context) and marks the others
    as covered (``done``)."""

    def __init__(self, n_shards: int, hot: np.ndarray):
        self.n_shards, self.hot = n_shards, hot
        self.clear()

    def clear(self) -> None:
        self.kept, self.ids, self.keys, self.sizes, self.held = [], [], [], [], 0

    def add(self, a: np.ndarray, c: np.ndarray, at: np.ndarray, doc: int, key: int, size: int) -> None:
        self.kept.append((a, c, np.full(len(at), len(self.ids), np.int32), at.astype(np.int32)))
        self.ids.append(doc)
        self.keys.append(key)
        self.sizes.append(size)
        self.held += len(at)

    def flush(self) -> pa.RecordBatch:
        a, c, d, s = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        ids, keys, sizes = np.array(self.ids, np.int64), np.array(self.keys, np.int64), np.array(self.sizes, np.int32)
        self.clear()
        order = np.lexsort((s, keys[d], ids[d], c, a))
        a, c, d, s = a[order], c[order], d[order], s[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        out = []
        for done, keep in ((False, first), (True, later(first, ids[d], keys[d], s))):
            at = np.flatnonzero(keep)
            at = at[np.lexsort((s[at], d[at]))]
            shard = (np.where(is_hot(a[at], self.hot), c[at], a[at]) >> np.uint64(20)) % np.uint64(self.n_shards)
            shard = shard.astype(np.uint16 if self.n_shards < 1 << 16 else np.int64)
            order = np.argsort(shard, kind="stable")
            at, shard = at[order], shard[order]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    x = at[i:j]
                    rows, index = np.unique(d[x], return_inverse=True)
                    out.append(
                        (
                            int(shard[i]),
                            done,
                            b"" if done else a[x].tobytes(),
                            b"" if done else c[x].tobytes(),
                            np.diff(index, prepend=0).astype("<i4").tobytes(),
                            np.diff(s[x], prepend=0).astype("<i4").tobytes(),
                            ids[rows].tobytes(),
                            keys[rows].tobytes(),
                            sizes[rows].tobytes(),
                        )
                    )
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)],
            names=ASK.replace(",", "").split()[::2],
        )


def _ask(documents: DataFrame, n_shards: int, length: int, hot: np.ndarray) -> DataFrame:
    """Anchors of all documents, with their contexts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer(n_shards, hot)
        for b in batches:
            texts, _ = text_bytes(b.column("text"))
            own, text_keys = b.column("doc_id").fill_null(int(LAST)).to_pylist(), b.column("key").to_pylist()
            for i, t in enumerate(texts):
                if not t or len(t) < length:
                    continue
                at, g, c = anchors(t, length)
                buffer.add(g, c, at, own[i], text_keys[i], len(t))
                if buffer.held >= BUFFER:
                    yield buffer.flush()
        if buffer.held:
            yield buffer.flush()

    return documents.select("doc_id", "key", "text").mapInArrow(lean(run), ASK)


def _ask_strings(contexts: DataFrame, n_shards: int, length: int) -> DataFrame:
    """Strings of ``length`` bytes that hold the anchor of a context, each as anchor and context: two independent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Buffer(n_shards, np.zeros(0, np.uint64))
        for b in batches:
            for doc, key, start, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "start", "context")), strict=True):
                raw = np.frombuffer(text, np.uint8).astype(np.uint64)
                h = gram_hashes(mix(raw + np.uint64(1)), length, _M2)
                other = gram_hashes(mix(raw + np.uint64(977)), length, _M1)
                buffer.add(h, other, start + np.arange(len(h)), doc, key, start + len(text))
                if buffer.held >= BUFFER:
                    yield buffer.flush()
        if buffer.held:
            yield buffer.flush()

    return contexts.select("doc_id", "key", "start", "context").mapInArrow(lean(run), ASK)


def _ranges(kind, d, k, start, stop, a, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(d), kind, np.int32)),
            pa.array(d, pa.int64()),
            pa.array(k, pa.int64()),
            pa.array(start, pa.int32()),
            pa.array(stop, pa.int32()),
            pa.array(a, pa.int64()),
            pa.array(at, pa.int32()),
        ],
        names=[x.split()[0] for x in RANGES.split(", ")],
    )


def joined(d, k, start, stop) -> tuple[np.ndarray, ...]:
    """Ranges of the same document that touch, as one."""
    order = np.lexsort((stop, start, k, d))
    d, k, start, stop = d[order], k[order], start[order], stop[order]
    if not len(d):
        return d, k, start, stop
    doc = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
    shift = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(stop + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return d[at], k[at], start[at], (reach - shift)[np.append(at[1:], len(d)) - 1]


def _settle(before: int, after: int, hot: np.ndarray, most: int):
    """For anchors whose contexts go from ``before`` bytes before them to ``after`` bytes after their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Covered ranges (kind 0), and contexts of anchors that have several, one occurrence of each (kind 1; kind 2 if
        there are more than ``most``, or may be)."""
        rows, done = [], []
        for b in batches:
            for r in b.to_pylist():
                index = np.cumsum(np.frombuffer(r["docs"], "<i4"))
                d, k = np.frombuffer(r["ids"], np.int64)[index], np.frombuffer(r["keys"], np.int64)[index]
                s = np.cumsum(np.frombuffer(r["starts"], "<i4"))
                n = np.frombuffer(r["sizes"], np.int32)[index]
                if r["done"]:
                    done.append((d, k, s, n))
                else:
                    rows.append((np.frombuffer(r["anchors"], np.uint64), np.frombuffer(r["contexts"], np.uint64), d, k, s, n))
        if rows:
            a, c, d, k, s, n = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((s, k, d, c, a))
            a, c, d, k, s, n = (x[order] for x in (a, c, d, k, s, n))
            same = a[1:] == a[:-1]
            first = np.concatenate(([True], ~same | (c[1:] != c[:-1])))
            over = later(first, d, k, s)
            done.append((d[over], k[over], s[over], n[over]))
            a, d, k, s, n = (x[first] for x in (a, d, k, s, n))
            same = a[1:] == a[:-1]
            group = np.cumsum(np.concatenate(([0], ~same)))
            count = np.bincount(group)[group]
            many = (count > most) | is_hot(a, hot)
            for kind, keep in ((1, (count > 1) & ~many), (2, many)):
                if keep.any():
                    at = s[keep]
                    stop = np.minimum(at + after, n[keep])
                    yield _ranges(kind, d[keep], k[keep], np.maximum(at - before, 0), stop, a[keep].view(np.int64), at)
        d, k, s, n = (np.concatenate(x) for x in zip(*done, strict=True))  # of a group, which has a row at least
        d, k, start, stop = joined(d, k, np.maximum(s - before, 0).astype(np.int64), np.minimum(s + after, n).astype(np.int64))
        zero = np.zeros(len(d), np.int64)
        yield _ranges(0, d, k, start, stop, zero, zero)

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the contexts that are asked of each document."""
    for b in batches:
        texts, _ = text_bytes(b.column("text"))
        doc, key, rows = [], [], []
        for i, (t, asked) in enumerate(zip(texts, b.column("asked").to_pylist(), strict=True)):
            own = b.column("doc_id")[i].as_py()
            for r in asked:
                rows.append((r["kind"], r["anchor"], r["start"], r["at"], t[r["start"] : r["stop"]]))
                doc.append(int(LAST) if own is None else own)
                key.append(b.column("key")[i].as_py())
        kind, a, start, at, text = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind, pa.int32()),
                pa.array(a, pa.int64()),
                pa.array(doc, pa.int64()),
                pa.array(key, pa.int64()),
                pa.array(start, pa.int32()),
                pa.array(at, pa.int32()),
                pa.array(text, pa.binary()),
            ],
            names=["kind", "anchor", "doc_id", "key", "start", "at", "context"],
        )


def _sort(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Covered ranges of the contexts of a shard, by suffix sorting."""
        t = pa.Table.from_batches(list(batches))
        a, d, k, s = (t.column(c).to_numpy() for c in ("anchor", "doc_id", "key", "start"))
        order = np.argsort(a, kind="stable")
        texts = t.column("context").to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # whole anchors, as many as fit into one text
        bounds = [0, *(np.flatnonzero(np.diff(a[order])) + 1).tolist(), len(order)]
        out, first = [], 0
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j == len(order) or int(sizes[order[first:j]].sum()) >= SORT_BYTES:
                out.append(_covered(order[first:j], texts, sizes, d, k, s, length))
                first = j
        d, k, start, stop = joined(*(np.concatenate(x) for x in zip(*out, strict=True)))
        zero = np.zeros(len(d), np.int64)
        yield _ranges(0, d, k, start, stop, zero, zero)

    return run


def _covered(rows, texts, sizes, d, k, s, length):
    """Ranges of the strings in some contexts that an earlier string equals."""
    text = np.frombuffer(b"".join(texts[i] for i in rows.tolist()), np.uint8)
    n = sizes[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    begin = np.cumsum(n) - n
    suffixes, common = Sorter(text, length).sort()
    left = (begin + n)[owner[suffixes]] - suffixes
    keep = left >= length  # suffixes that hold a whole string of their context
    # the common prefix of neighbours among those kept is the least of the values between them
    at = np.flatnonzero(keep)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    between = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
    group = np.cumsum(np.concatenate(([0], between[1:] < length)))
    p = suffixes[at]
    row = rows[owner[p]]
    start = s[row] + (p - begin[owner[p]])
    order = np.lexsort((start, k[row], d[row], group))
    group, row, start = group[order], row[order], start[order]
    new = np.concatenate(([True], group[1:] != group[:-1]))
    over = later(new, d[row], k[row], start)
    row, start = row[over], start[over].astype(np.int64)
    return d[row], k[row], start, start + length


def repeated_ranges(documents: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, key, start, stop: byte ranges that earlier strings cover; ranges may overlap."""

    def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(text) < length:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return anchors(text, length)[1:]

    n_shards, hot = parts_for(total_bytes(documents), SHARD_BYTES), hot_anchors(documents, of)
    settle = _settle(length - ANCHOR, length, hot, most)
    found = cut(_ask(documents, n_shards, length, hot).groupBy("shard").applyInArrow(lean(settle), RANGES), "anchors")
    whole = F.when(F.col("doc_id") != int(LAST), F.col("doc_id"))
    asked = found.where("kind > 0").groupBy(whole.alias("doc_id"), "key").agg(
        F.collect_list(F.struct("kind", "start", "stop", "anchor", "at")).alias("asked")
    )
    on = F.col("t.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("t.key") == F.col("q.key"))
    # equal rows are one document here
    one = documents.alias("t").join(asked.alias("q"), on).select("t.doc_id", "t.key", "t.text", "q.asked")
    fetched = one.mapInArrow(lean(_fetch), "kind int, anchor long, doc_id long, key long, start int, at int, context binary")
    strings = not found.where("kind = 2").isEmpty()
    if strings:
        fetched = cut(fetched, "contexts")
    size = found.where("kind = 1").agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(parts_for(size, SHARD_BYTES))).cast("int").alias("shard")
    few = fetched.where("kind = 1").select(shard, "anchor", "doc_id", "key", "start", "context").groupBy("shard")
    parts = [found.where("kind = 0"), cut(few.applyInArrow(lean(_sort(length)), RANGES), "sorted")]
    if strings:
        each = _ask_strings(fetched.where("kind = 2"), n_shards, length).groupBy("shard")
        nothing = np.zeros(0, np.uint64)
        settled = each.applyInArrow(lean(_settle(0, length, nothing, 1)), RANGES)
        parts.append(cut(settled.where("kind = 0"), "strings"))
    return reduce(DataFrame.union, parts).select(whole.alias("doc_id"), "key", "start", "stop")


def _with_ranges(documents: DataFrame, length: int, most: int = MOST) -> DataFrame:
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    ranges = repeated_ranges(table, length, most).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", "stop")).alias("ranges")
    )
    on = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key"))
    return table.alias("d").join(ranges.alias("r"), on, "left").select("d.doc_id", "d.text", "r.ranges")


def spans(ranges: list[dict] | None) -> list[int]:
    out: list[int] = []
    for a, b in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def kept_bytes(text: bytes | None, removed: list[int]) -> bytes:
    text = text or b""
    edges = [0, *removed, len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, removed (flat [start, stop) pairs of bytes) for every row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed = [spans(r) for r in b.column("ranges").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text"), pa.array(removed, pa.list_(pa.int32()))],
                names=["doc_id", "text", "removed"],
            )

    return _with_ranges(documents, length).mapInArrow(lean(run), "doc_id long, text string, removed array<int>")


def digest_documents(documents: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: as ``repeated_spans``, but only digests leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = text_bytes(b.column("text"))
            removed = [spans(r) for r in b.column("ranges").to_pylist()]
            kept = [hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(texts, removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(sizes),
                    pa.array([sum(r[1::2]) - sum(r[::2]) for r in removed], pa.int64()),
                    pa.array([len(r) // 2 for r in removed], pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_ranges(documents, length, most).mapInArrow(
        lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
