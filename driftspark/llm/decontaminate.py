"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n`` consecutive words of a
benchmark item; an item of fewer words is one window. Words become ids of the benchmark's own vocabulary (0: not in
it), so a rolling hash over ids proposes hits and the id sequence itself verifies them: a hit is never a collision.

What is broadcast is bounded: items are cut into pieces of ``PIECE_WORDS`` windows, and these are dealt to chunks of at
most ``CHUNK_WINDOWS`` windows and ``CHUNK_BYTES`` of text (twice the expected load). A chunk's index is sorted arrays of
about 60 bytes a window, and its vocabulary. Documents are scanned once per chunk and the spans found so far travel with
each document. One chunk is the usual case.

Defined results: a null text has no words; a null or wordless item has no window; repeated items count by distinct
item_id (a null id reads as the empty string); repeated documents each keep a row; an empty benchmark hits nothing and an
empty documents table gives no rows; a very long text is read whole, by itself;
further columns are ignored, or returned if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import apart, alnum_words, cut, map_batches, pieces, text_bytes, with_columns

WINDOW = 10
CHUNK_BYTES, CHUNK_WINDOWS = 32 << 20, 2 << 20
PIECE_WORDS = 4096
#: Words of a text in Spark, after A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MULT = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, text string, n_words long, spans array<int>, items array<string>"


class Windows:
    """Distinct windows of one length, by ascending hash: their ids, and the numbers of their items from ``first`` on."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, item: np.ndarray, n: int):
        rows = ids[starts[:, None] + np.arange(n)]
        h = rolling(rows.astype(np.uint64), n)[:, 0]
        order = np.lexsort((item, *rows.T[::-1], h))
        rows, h, item = rows[order], h[order], item[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        once = new.copy()
        once[1:] |= item[1:] != item[:-1]
        self.n, self.hashes, self.ids, self.items = n, h[new], rows[new], item[once]
        self.first = np.append(np.flatnonzero(new[once]), len(self.items))
        same = np.flatnonzero(np.append(True, self.hashes[1:] != self.hashes[:-1]))
        #: windows that share a hash at most
        self.alike = int(np.diff(np.append(same, len(self.hashes))).max())

    def find(self, ids: np.ndarray, at: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of ``at`` (with hashes ``h``) whose ids are those of a window, and the places of these windows."""
        where = np.searchsorted(self.hashes, h)
        for _ in range(self.alike):
            near = np.flatnonzero(where < len(self.hashes))
            near = near[self.hashes[where[near]] == h[near]]
            near = near[(ids[at[near][:, None] + np.arange(self.n)] == self.ids[where[near]]).all(axis=1)]
            yield at[near], where[near]
            where = where + 1


class Index:
    """Windows of some items: vocabulary, names of the items, and for each length its ``Windows``."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            split = alnum_words(text)
            if split:
                ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in split), np.int32, len(split))
                by_length.setdefault(min(window, len(ids)), []).append((numbers.setdefault(item, len(numbers)), ids))
        self.names = list(numbers)
        self.windows = []
        for n, some in by_length.items():
            sizes = np.array([len(ids) for _, ids in some])
            many = sizes - n + 1
            starts = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(many) + many, many) + np.arange(many.sum())
            item = np.repeat(np.array([k for k, _ in some], np.int32), many)
            self.windows.append(Windows(np.concatenate([ids for _, ids in some]), starts, item, n))

    def find(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(start, length, items) of every window that occurs in an id sequence; 0 breaks a sequence."""
        found = []
        known = ids != 0
        runs = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        starts, ends = runs[::2], runs[1::2]
        for of_length in self.windows:
            n = of_length.n
            keep = ends - starts >= n
            if not keep.any():
                continue
            a, m = starts[keep], (ends - starts)[keep] - n + 1
            at = np.repeat(a - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            h = np.zeros(len(at), np.uint64)
            for j in range(n):
                h = h * _MULT + ids[at + j].astype(np.uint64)
            for positions, places in of_length.find(ids, at, h):
                for p, w in zip(positions.tolist(), places.tolist(), strict=True):
                    of = of_length.items[of_length.first[w] : of_length.first[w + 1]]
                    found.append((p, n, [self.names[k] for k in of.tolist()]))
        return found


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of rows of n ids, as one column."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(n):
        h = h * _MULT + ids[:, j]
    return h[:, None]


def _chunks(benchmark: DataFrame, window: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of chunks and the chunks, as pieces of items; one at a time comes to the driver. Pieces of an item
    overlap by ``window`` - 1 words, so that they hold its windows and no others."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    split = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(PATTERN), F.lit(0)).alias("w")
    whole = benchmark.where(F.col("text").isNotNull()).select(item, split).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(PIECE_WORDS))
    table = whole.select("item", "w", F.explode(starts).alias("at"))
    table = table.select("item", F.array_join(F.slice("w", F.col("at") + 1, PIECE_WORDS + window - 1), " ").alias("text"), F.size("w").alias("n"), "at")
    many = F.least(F.lit(PIECE_WORDS), F.greatest(F.lit(1), F.col("n") - F.col("at") - window + 1))
    size = table.agg(F.sum(F.octet_length("text")), F.sum(many)).first()
    n = max(1, -(-(size[0] or 0) // (CHUNK_BYTES // 2)), -(-(size[1] or 0) // (CHUNK_WINDOWS // 2)))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return n, ([(r["item"], r["text"].encode()) for r in table.where(part == k).select("item", "text").collect()] for k in range(n))


def scan(documents: DataFrame, items: list[tuple[str, bytes]], window: int = WINDOW) -> DataFrame:
    """One pass of documents (doc_id, text, spans, items, further columns) over the windows of some items; adds to spans
    and items."""
    shared = documents.sparkSession.sparkContext.broadcast(Index(items, window))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        get = index.vocab.get
        texts, sizes = text_bytes(b.column("text"))
        spans, names = b.column("spans").to_pylist(), b.column("items").to_pylist()
        counts = np.zeros(b.num_rows, np.int64)
        for lo, hi in pieces(sizes):
            flat: list[bytes] = []
            starts = np.zeros(hi - lo + 1, np.int64)
            for i in range(lo, hi):
                if texts[i]:
                    flat += alnum_words(texts[i])
                flat.append(b"")
                counts[i] = len(flat) - 1 - starts[i - lo]
                starts[i - lo + 1] = len(flat)
            ids = np.fromiter(map(get, flat, repeat(0)), np.int64, len(flat))
            found = index.find(ids)
            docs = np.searchsorted(starts, [p for p, _, _ in found], side="right") - 1
            for d, (p, n, hit) in zip(docs.tolist(), found, strict=True):
                i, p = lo + d, int(p - starts[d])
                spans[i] = (spans[i] or []) + [p, p + n]
                names[i] = sorted({*(names[i] or []), *hit})
        return pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("text"),
                pa.array(counts),
                pa.array([merged(s) for s in spans], pa.list_(pa.int32())),
                pa.array([n or [] for n in names], pa.list_(pa.string())),
                *(b.column(c) for c in kept),
            ],
            names=["doc_id", "text", "n_words", "spans", "items", *kept],
        )

    kept = [c for c in documents.columns if c not in ("doc_id", "text", "n_words", "spans", "items")]
    return map_batches(documents.select("doc_id", "text", "spans", "items", *kept), batch, with_columns(SCHEMA, documents, kept))


def merged(flat: list[int] | None) -> list[int]:
    """Disjoint, ascending [start, end) pairs of a flat list of pairs."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)) if flat else ():
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, kept: Sequence[str] = ()
) -> DataFrame:
    """doc_id, text, n_words, spans (flat [start, end) pairs of hit words), items (sorted) and the columns named in
    ``kept`` for every document. A further column that is named like a result comes back as own_<name>."""
    names = ["doc_id", "text", "n_words", "spans", "items"]
    away, back = apart(kept, *names)
    out = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *away,
        F.lit(None).cast("array<int>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    n, chunks = _chunks(benchmark, window)
    for k, items in enumerate(chunks):
        out = scan(out, items, window)
        if k + 1 < n:
            out = cut(out, "contamination")
    return out.select(*names, *back)


def clean_documents(documents: DataFrame, found: DataFrame, most_words: int = 0) -> DataFrame:
    """Documents of which at most ``most_words`` words are hit. Needs one row per doc_id on both sides."""
    bad = found.where(hit_words() > most_words).select("doc_id")
    return documents.join(bad, "doc_id", "left_anti")


def hit_words():
    """Number of hit words of a row of ``contamination``."""
    pairs = F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int"))
    total = F.aggregate(
        pairs, F.lit(0).cast("long"), lambda s, i: s + F.get("spans", i * 2 + 1) - F.get("spans", i * 2)
    )
    return F.when(F.size("spans") > 0, total).otherwise(F.lit(0).cast("long"))


def remove_spans(text: bytes, spans: list[int]) -> bytes:
    """A text without its hit words (and what stands between neighbouring hit words)."""
    import re

    at = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])
