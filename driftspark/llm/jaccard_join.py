"""Exact Jaccard join of n-gram sets by partitioning the token universe (pigeonhole), one-deletion neighbourhoods and
cost-based allocation.

Two sets with Jaccard similarity of at least t differ in at most ``(|r| + |s|) * (1 - t) / (1 + t)`` tokens. Sizes fall
into bands. The scheme of a band hashes tokens into m segments; a set takes part in the scheme of its own band and of
larger bands that hold possible partners, with H = the most tokens by which it can differ from a partner there. It
uses the first K = H + 1 + c segments of the scheme. Of the smaller K of two partners, at least c + 1 segments are equal.

*Allocation.* An empty segment would match nearly everything, and one of a single token whatever has that token: such
segments cost most and get nothing. A set with at most c of them indexes its other segments as they are, and one of the
equal ones is among them. A set with more also indexes the one-deletion neighbours of larger segments (these count
double), which makes up for what the costly ones lose; if even that is too little, it indexes those too. c is chosen for
each band by expected cost: one entry more for every set, against neighbourhoods for sets with over c costly segments.

*Buckets.* Sets whose entries are equal meet in a bucket, which sends star pairs (its centre, another). The centre is the
member with the least share of entries that it alone has in its buffer of documents, of these the smallest: one and the
same copy, nearly unchanged, serves most buckets of a group of copies, which keeps star pairs few. Every set has an odd
sketch: bits that each token flips. Sketches of two sets differ in at most as many bits as the sets in tokens, so a pair
whose sketches differ in too many bits is settled without its texts. The other star pairs are verified exactly on whole
texts, each document's most frequent pair first, then those that still join something new. All members of a bucket meet
in the group of its centre. Where a group is not connected by then, its members outside its largest part look for
partners in its other parts by sketch, in pieces of bounded size. Each gives its nearest ones that were not tried, first
``NEAREST``, then 16 times as many in each round; what verifies joins parts. A further round takes only the groups of
members that have more to give, and only these ask, until no plausible pair between two parts is untried. So every link
between different texts is found or follows from verified ones, and a large group of copies costs pairs in proportion to
its size. Equal sets are linked by a 128-bit digest first. A bucket that a sample shows to be frequent is spread over all
shards by its members; each part gives its centre, and the first of all (one row a frequent bucket) then forms the same
star pairs. Star pairs are counted in shards of pairs, not of centres.

Defined results: no words: an empty set, linked with nothing; fewer words than n: the whole sequence is one shingle;
rows that share a doc_id are one node; a null doc_id is linked with nothing and has a null component; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import apart, cut, lean, lower_words, parts_for, text_bytes, total_bytes
from driftspark.llm.components import components
from driftspark.llm.phrase_dedup import WordHashes, gram_hashes, hot_anchors, is_hot, mix

SHINGLE = 5
PER_CENT = 80
#: Bytes of text behind one shard of index entries, and tokens that a map task holds at once.
SHARD_BYTES = 8 << 20
BUFFER = 1 << 19
#: Partners that are verified with one copy of their representative.
SALT = 256
#: Bits (as a power of two) of the map of wanted documents: 8 MB, whatever the data.
BITMAP = 26
#: Segments of fewer tokens are costly: they match too many others.
LEAST = 2
#: Members and outliers of a group of star pairs that are compared in one piece of work.
MEMBERS, OUTLIERS = 4096, 2048
#: Partners that a member of an unconnected group gives in the first round.
NEAREST = 4
_MULT = np.uint64(0xD6E8FEB86659FD93)
PACKED = "shard int, kind int, entries binary, docs binary, ids binary, sizes binary, low binary, high binary, sketches binary"
FOUND = "kind int, a long, b long, n long, low long, high long, sketch binary"


@lru_cache(maxsize=None)
def bands(per_cent: int, up_to: int) -> list[tuple[int, int]]:
    """Size bands [lo, hi] from 1 on, so wide that partners lie in the same or the next band or two."""
    out, lo = [], 1
    while not out or out[-1][1] < up_to:
        hi = max(lo, -(-lo * 100 // per_cent) - 1)
        out.append((lo, hi))
        lo = hi + 1
    return out


def bound(r: int, s: int, per_cent: int) -> int:
    """The most tokens by which linked sets of these sizes can differ."""
    return (r + s) * (100 - per_cent) // (100 + per_cent)


@lru_cache(maxsize=None)
def spare(lo: int, hi: int, per_cent: int) -> int:
    """c of a band: minimises entries for every set plus expected neighbourhoods of sets with over c costly segments."""
    size, h = (lo + hi) / 2, bound(hi, hi, per_cent)
    best = None
    for c in range(0, h + 20):
        m = h + 1 + c
        mean = m * exp(-size / m) * sum((size / m) ** k / factorial(k) for k in range(LEAST))
        term = over = exp(-mean)
        for k in range(1, c + 1):
            term *= mean / k
            over += term
        cost = m + max(0.0, 1 - over) * 2 * size
        if best is None or cost < best[0]:
            best = (cost, c)
    return best[1]


@lru_cache(maxsize=1 << 16)
def plans(size: int, per_cent: int) -> list[tuple[int, int, int, int]]:
    """(scheme, m, K, c) of each scheme in which a set of this size takes part."""
    most = size * 100 // per_cent
    out = []
    for k, (lo, hi) in enumerate(bands(per_cent, 1 << (most + 1).bit_length())):
        if hi < size or lo > most:
            continue
        h = bound(size, min(hi, most), per_cent)
        if h:
            c = spare(lo, hi, per_cent)
            out.append((k, bound(hi, hi, per_cent) + 1 + c, h + 1 + c, c))
    return out


def shingle_set(split: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    if not split:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(hashes(split), min(n, len(split)), _MULT) + np.uint64(min(n, len(split)) * 7919))


def entries(tokens: np.ndarray, sizes: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries (hash, row of the set) of sets, given as one array of tokens and their sizes."""
    all_plans = [plans(int(n), per_cent) for n in sizes.tolist()]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out_h, out_d = [], []
    for slot in range(max(map(len, all_plans), default=0)):
        plan = np.array([p[slot] if slot < len(p) else (0, 0, 0, 0) for p in all_plans], np.int64)
        scheme, m, k, c = plan.T
        use = k[doc] > 0
        t, d = tokens[use], doc[use]
        seg = ((t >> np.uint64(32)) * m[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        keep = seg < k[d]
        t, d, seg = t[keep], d[keep], seg[keep]
        offset = np.concatenate(([0], np.cumsum(k)))
        at, total = offset[d] + seg, int(offset[-1])
        count = np.bincount(at, minlength=total)
        low = np.bincount(at, (t & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
        high = np.bincount(at, (t >> np.uint64(32)).astype(float), total).astype(np.uint64)
        sums = low + (high << np.uint64(32))
        owner = np.repeat(np.arange(len(k)), k)
        place = np.arange(total) - offset[owner]
        tag = mix((scheme[owner].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) + np.uint64(1))
        lacking = np.bincount(owner[count < LEAST], minlength=len(k)) > c
        emit = count >= LEAST
        for i in np.flatnonzero(lacking & (k > 0)).tolist():
            # v - 1 of each segment: 1 with its neighbours, 0 as it is, -1 if costly
            part = slice(offset[i], offset[i + 1])
            v = np.sign(count[part] - LEAST)
            least = 1 if k[i] < 16 else int(0.75 * k[i])
            if (np.cumsum(v)[least - 1 :] + c[i] < 0).any():
                emit[part] = True
        out_h.append(mix(sums[emit] + tag[emit]))
        out_d.append(owner[emit])
        near = lacking[d] & (count[at] > LEAST)
        out_h.append(mix(sums[at[near]] - t[near] + tag[at[near]]))
        out_d.append(d[near])
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d)


def _entries_of(text: bytes, shingle: int, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one text, and a hash of its set for each of them."""
    tokens = shingle_set(lower_words(text), WordHashes(), shingle)
    if len(tokens) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h, _ = entries(tokens, np.array([len(tokens)]), per_cent)
    return h, np.full(len(h), np.bitwise_xor.reduce(mix(tokens)), np.uint64)


def sketch_bytes(size: int) -> int:
    """A power of two that gives two to four bits a token."""
    return 1 << max(3, (2 * size - 1).bit_length() - 3) if size else 8


def sketch(tokens: np.ndarray) -> bytes:
    bits = 8 * sketch_bytes(len(tokens))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows) in the form of shorter ones: bits of equal lower digits are added up."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def differing(r: bytes, s: bytes) -> int:
    """At least so many tokens differ between two sets with these sketches."""
    x, y = (np.frombuffer(v, np.uint8)[None] for v in (r, s))
    w = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum())


def _index(documents: DataFrame, n_shards: int, shingle: int, per_cent: int, hot: np.ndarray) -> DataFrame:
    """Packed index entries by shard (kind 0) and a row of sizes and digests for the documents of a buffer (kind 1)."""

    def flush(sets, ids):
        sizes = np.array([len(s) for s in sets], np.int64)
        ids = np.array(ids, np.int64)
        low = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
        high = np.array([np.add.reduce(mix(s + _MULT)) if len(s) else 0 for s in sets], np.uint64)
        out = [(int(low[0] % np.uint64(n_shards)), 1, b"", b"", ids.tobytes(), sizes.tobytes(), low.tobytes(), high.tobytes(), b"".join(map(sketch, sets)))]
        order = np.lexsort((ids, high, low, sizes))
        new = np.ones(len(sets), bool)
        x = order
        new[1:] = (sizes[x][1:] != sizes[x][:-1]) | (low[x][1:] != low[x][:-1]) | (high[x][1:] != high[x][:-1])
        rows = np.sort(x[new & (sizes[x] > 1)])
        if len(rows):
            h, d = entries(np.concatenate([sets[i] for i in rows.tolist()]), sizes[rows], per_cent)
            rank = _ranks(h, d, len(rows))
            place = np.where(is_hot(h, hot), mix(h ^ ids[rows][d].view(np.uint64)), h)
            shard = ((place >> np.uint64(40)) % np.uint64(n_shards)).astype(np.uint16 if n_shards < 1 << 16 else np.int64)
            order = np.argsort(shard, kind="stable")
            h, d, shard = h[order], d[order], shard[order]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    mine, at = np.unique(d[i:j], return_inverse=True)
                    back = np.argsort(at, kind="stable")
                    steps = np.diff(at[back], prepend=0).astype("<u2")
                    out.append((int(shard[i]), 0, h[i:j][back].tobytes(), steps.tobytes(), ids[rows[mine]].tobytes(), rank[mine].tobytes(), b"", b"", b""))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)],
            names=PACKED.replace(",", "").split()[::2],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sets, ids, held = [], [], 0
        for b in batches:
            texts, _ = text_bytes(b.column("text"))
            for i, t in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                sets.append(shingle_set(lower_words(t) if t else [], hashes, shingle))
                ids.append(i)
                held += len(sets[-1]) + 50
                if held >= BUFFER:
                    yield flush(sets, ids)
                    sets, ids, held = [], [], 0
        if sets:
            yield flush(sets, ids)

    return documents.select("doc_id", "text").where("doc_id is not null").mapInArrow(lean(run), PACKED)


def _ranks(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets with entries (h, d), the share (0 to 255) of its entries that no other set of the buffer has."""
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    alone = np.bincount(d, count[at] == 1, n)
    return (255 * alone / np.maximum(np.bincount(d, minlength=n), 1)).astype(np.uint8)


def _starts(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))


def _pairs(a: np.ndarray, b: np.ndarray, n_subs: int) -> tuple[list[int], list[int], list[bytes]]:
    """Star pairs packed by sub-shards of pairs: sub-shards, numbers of pairs, packed pairs."""
    sub = (mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + np.uint64(1))) % np.uint64(n_subs)).astype(np.int64)
    order = np.argsort(sub, kind="stable")
    a, b, sub = a[order], b[order], sub[order]
    cuts = [0, *(np.flatnonzero(np.diff(sub)) + 1).tolist(), len(sub)]
    spans = [(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j]
    return [int(sub[i]) for i, _ in spans], [j - i for i, j in spans], [a[i:j].tobytes() + b[i:j].tobytes() for i, j in spans]


def _stars(batches: Iterator[pa.RecordBatch], n_subs: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents of a shard (kind 1: a, n, low, high, sketch), its star pairs (centre of a bucket, other member), packed
    (kind 0: a = sub-shard, n = number of pairs), and its parts of frequent buckets (kind 2: a = bucket, b = the part's
    centre, n = number of members, low = rank of the centre, packed members)."""
    hashes, docs, ranks = [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            if r["kind"]:
                sizes = np.frombuffer(r["sizes"], np.int64)
                ends = np.cumsum([sketch_bytes(n) for n in sizes.tolist()])
                cut_up = [r["sketches"][i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield _found(1, ids, ids, sizes, *(np.frombuffer(r[x], np.int64) for x in ("low", "high")), cut_up)
            else:
                hashes.append(np.frombuffer(r["entries"], np.uint64))
                at = np.cumsum(np.frombuffer(r["docs"], "<u2").astype(np.int64))
                docs.append(ids[at])
                ranks.append(np.frombuffer(r["sizes"], np.uint8)[at])
    if not hashes:
        return
    h, d, rank = np.concatenate(hashes), np.concatenate(docs), np.concatenate(ranks)
    order = np.lexsort((d, rank, h))
    h, d, rank = h[order], d[order], rank[order]
    start = _starts(h)
    size = np.diff(np.append(start, len(h)))
    frequent = is_hot(h[start], hot)
    centre = np.repeat(d[start], size)
    pair = (centre != d) & ~np.repeat(frequent, size)
    sub, n, packed = _pairs(centre[pair], d[pair], n_subs)
    if sub:
        zero = np.zeros(len(sub), np.int64)
        yield _found(0, np.array(sub), zero, np.array(n), zero, zero, packed)
    if frequent.any():
        at, n = start[frequent], size[frequent]
        zero = np.zeros(len(at), np.int64)
        members = [d[i : i + k].tobytes() for i, k in zip(at.tolist(), n.tolist(), strict=True)]
        yield _found(2, h[at].view(np.int64), d[at], n, rank[at].astype(np.int64), zero, members)


def _frequent_pairs(found: DataFrame, n_subs: int) -> DataFrame:
    """sub, sketch: packed star pairs of the frequent buckets, once the parts' centres are known."""
    parts = found.where("kind = 2").select("a", "b", "low", "sketch")
    centre = parts.groupBy("a").agg(F.min(F.struct("low", "b"))["b"].alias("centre"))  # one row a frequent bucket, of which there are HOT_MOST at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            members = [np.frombuffer(m, np.int64) for m in x.column("sketch").to_pylist()]
            first = np.repeat(x.column("centre").to_numpy(), list(map(len, members)))
            other = np.concatenate(members)
            sub, _, packed = _pairs(first[other != first], other[other != first], n_subs)
            yield pa.RecordBatch.from_arrays([pa.array(sub, pa.int64()), pa.array(packed, pa.binary())], names=["sub", "sketch"])

    return parts.join(F.broadcast(centre), "a").select("centre", "sketch").mapInArrow(lean(run), "sub long, sketch binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct star pairs (a, b) of a sub-shard, with the number of their buckets."""
    both = [np.frombuffer(x, np.int64).reshape(2, -1) for t in batches for x in t.column("sketch").to_pylist()]
    a, b = np.concatenate(both, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    yield pa.RecordBatch.from_arrays(
        [pa.array(a[at]), pa.array(b[at]), pa.array(np.diff(np.append(at, len(a))))], names=["a", "b", "n"]
    )


def _found(kind, a, b, n, low, high, sketches) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (a, b, n, low, high)), pa.array(sketches, pa.binary())],
        names=["kind", "a", "b", "n", "low", "high", "sketch"],
    )


def _plausible(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches leave room for a link; a doc_id with several sets is never ruled out."""
    one = sets.groupBy("doc_id").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("rows"))
    side = lambda c: one.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "rows")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    single = (F.col("rows_a") == 1) & (F.col("rows_b") == 1)
    both = both.where(~single | (100 * small >= per_cent * large))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [
                not r["single"] or differing(r["sketch_a"], r["sketch_b"]) <= bound(r["n_a"], r["n_b"], per_cent)
                for r in x.to_pylist()
            ]
            yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    both = both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", single.alias("single"))
    return both.mapInArrow(lean(run), "a long, b long")


def _across(
    member: DataFrame, parts: DataFrame, sets: DataFrame, tried: DataFrame, per_cent: int, most: int
) -> tuple[DataFrame, DataFrame]:
    """Plausible pairs between the parts of each group of ``member`` (a, doc_id, asks) that is not connected: the ``most``
    nearest that were not tried (in each piece of work) for each member that asks, or where that is null, for each one
    outside the largest part. Returns a table of them (a, b, false) and of the members that have more to give (group,
    doc_id, true), and the members for the next round: the groups of these, in which only these ask. That is enough: of
    two members between two parts, one at least asks, and it gives the pair or has more to give."""
    named = member.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = cut(named.select("a", "doc_id", F.coalesce("component", "doc_id").alias("part"), "asks"), "members")
    sizes = named.groupBy("a", "part").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking"))
    whole = sizes.groupBy("a").agg(
        F.sum("n").alias("n"),
        F.max("n").alias("most"),
        F.max_by("part", F.struct("n", "part")).alias("largest"),
        F.coalesce(F.sum("asking"), F.sum("n") - F.max("n")).alias("asking"),
    )
    whole = whole.where("n > most and asking > 0").select(
        "a",
        "largest",
        F.ceil(F.col("n") / MEMBERS).cast("int").alias("member_parts"),
        F.ceil(F.col("asking") / OUTLIERS).cast("int").alias("outlier_parts"),
    )
    mine = named.join(whole, "a")
    out = F.coalesce("asks", F.col("part") != F.col("largest"))
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    members = mine.select("a", "doc_id", "part", F.lit(False).alias("out"), place("member_parts").alias("x"), F.explode(spread("outlier_parts")).alias("y"))
    outliers = mine.where(out).select("a", "doc_id", "part", F.lit(True).alias("out"), F.explode(spread("member_parts")).alias("x"), place("outlier_parts").alias("y"))
    rows = members.union(outliers).join(sets.select("doc_id", "n", "sketch"), "doc_id").withColumn("other", F.lit(None).cast("long"))
    # pairs that were tried go to the piece of work that would find them again
    both = tried.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).union(tried.select("b", "a"))
    known = both.join(mine.where(out).select("a", "doc_id", "member_parts", "outlier_parts"), "doc_id").select(
        "doc_id", "a", F.lit(None).cast("long").alias("part"), F.lit(None).cast("boolean").alias("out"),
        F.pmod(F.xxhash64("other"), F.col("member_parts")).cast("int").alias("x"), place("outlier_parts").alias("y"),
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch"), "other",
    )
    rows = rows.unionByName(known)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        old = t.filter(pc.is_valid(t.column("other")))
        skip: dict[int, list[int]] = {}
        for i, j in zip(old.column("doc_id").to_pylist(), old.column("other").to_pylist(), strict=True):
            skip.setdefault(i, []).append(j)
        t = t.filter(pc.is_null(t.column("other")))
        if not t.num_rows:
            return
        ids, part, n, out = (t.column(c).to_numpy() for c in ("doc_id", "part", "n", "out"))
        raw = t.column("sketch").to_pylist()
        width = np.array([len(r) for r in raw])
        nearest: dict[int, list[tuple[int, int]]] = {}
        untried: dict[int, int] = {}
        for w in np.unique(width[out]).tolist():
            o = np.flatnonzero(out & (width == w))
            own = np.frombuffer(b"".join(raw[i] for i in o.tolist()), np.uint8).reshape(len(o), w)
            for v in (w // 2, w, w * 2):
                m = np.flatnonzero(~out & (width == v))
                if not len(m):
                    continue
                theirs = np.frombuffer(b"".join(raw[i] for i in m.tolist()), np.uint8).reshape(len(m), v)
                a, b = folded(own, min(v, w)), folded(theirs, min(v, w))
                if min(v, w) >= 8:
                    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
                by_size = np.argsort(n[m], kind="stable")
                m, b = m[by_size], b[by_size]
                low = np.searchsorted(n[m], -(-per_cent * n[o] // 100), side="left")
                high = np.searchsorted(n[m], n[o] * 100 // per_cent, side="right")
                for k, i in enumerate(o.tolist()):
                    near = slice(low[k], high[k])
                    far = np.bitwise_count(b[near] ^ a[k]).sum(axis=1).astype(np.int64)
                    ok = far <= (n[i] + n[m[near]]) * (100 - per_cent) // (100 + per_cent)
                    ok &= part[m[near]] != part[i]
                    if ok.any() and (gone := skip.get(int(ids[i]))):
                        ok &= ~np.isin(ids[m[near]], gone)
                    untried[i] = untried.get(i, 0) + int(ok.sum())
                    best = np.lexsort((ids[m[near]][ok], far[ok]))[:most]
                    nearest.setdefault(i, []).extend(zip(far[ok][best].tolist(), ids[m[near]][ok][best].tolist(), strict=True))
        found = sorted({(min(int(ids[i]), j), max(int(ids[i]), j)) for i, v in nearest.items() for _, j in sorted(v)[:most]})
        group = t.column("a")[0].as_py()
        rows = [(*p, False) for p in found] + [(group, int(ids[i]), True) for i, k in untried.items() if k > most]
        a, b, more = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], names=["a", "b", "more"]
        )

    pieces = rows.select("a", "x", "y", "doc_id", "part", "n", "sketch", "out", "other").groupBy("a", "x", "y")
    found = cut(pieces.applyInArrow(lean(compare), "a long, b long, more boolean"), "across")
    asking = found.where("more").select("a", F.col("b").alias("doc_id"), F.lit(True).alias("asks")).distinct()
    left = named.select("a", "doc_id").join(asking.select("a").distinct(), "a", "left_semi")
    left = left.join(asking, ["a", "doc_id"], "left").select("a", "doc_id", F.coalesce("asks", F.lit(False)).alias("asks"))
    return found, left


def verified(documents: DataFrame, pairs: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets are similar enough, checked on whole texts.

    Texts travel to their pair's a; a document with many partners is copied for every ``SALT`` of them."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SALT).cast("int")
    partner = pairs.join(counts, "a").select(
        "a", F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt")
    )
    own = counts.select("a", F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    asked = documents.join(partner.union(own), "doc_id").select("a", "salt", "doc_id", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mine, others, a = WordHashes(), [], [], 0
        for b in batches:
            texts, _ = text_bytes(b.column("text"))
            a = b.column("a")[0].as_py()
            for i, t in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                s = shingle_set(lower_words(t) if t else [], hashes, shingle)
                (mine if i == a else others).append((i, s))
        good = sorted({i for i, s in others for _, r in mine if similar(r, s, per_cent)})
        yield pa.RecordBatch.from_arrays(
            [pa.array([a] * len(good), pa.int64()), pa.array(good, pa.int64())], names=["a", "b"]
        )

    return cut(asked.groupBy("a", "salt").applyInArrow(lean(check), "a long, b long"), "verified")


def involved(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is in ids, as a table. A bitmap of bounded size keeps most others out of the shuffle."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    bits = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k"))
    rows = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    held = {r["k"]: np.frombuffer(r["bits"], np.uint8) for r in rows}
    wide = len(next(iter(held.values()))) if held else 1
    table = np.zeros((max(held, default=0) + 1, wide), np.uint8)
    for k, b in held.items():
        table[k] = b
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value.ravel()
        for b in batches:
            at = b.column("k").to_numpy() * (8 * shared.value.shape[1]) + b.column("bit").to_numpy()
            byte = np.minimum(at >> 3, len(flat) - 1)
            out = b.filter(pa.array((at >> 3 == byte) & (flat[byte] >> (at & 7).astype(np.uint8) & 1 > 0)))
            yield out.select(["doc_id", "text"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP))
    asked = documents.where("doc_id is not null").select(
        "doc_id", "text", F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit")
    )
    kept = asked.mapInArrow(lean(keep), "doc_id long, text string")
    return cut(kept.join(ids, "doc_id", "left_semi"), "involved")


def similar(r: np.ndarray, s: np.ndarray, per_cent: int) -> bool:
    small, large = sorted((len(r), len(s)))
    if not small or 100 * small < per_cent * large:
        return False
    both = len(np.intersect1d(r, s, assume_unique=True))
    return 100 * both >= per_cent * (small + large - both)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) that no chain of links connects yet."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def near_duplicates(
    documents: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT, kept: Sequence[str] = ()
) -> DataFrame:
    """doc_id, the columns named in ``kept``, n_shingles, component_id of every document.

    A further column that is named like a result comes back as own_<name>; an empty table gives no rows; texts of any length
    are compared whole."""
    table = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_shards = parts_for(total_bytes(table), SHARD_BYTES)
    hot = hot_anchors(table.where("doc_id is not null"), lambda text: _entries_of(text, shingle, per_cent))
    shards = _index(table, n_shards, shingle, per_cent, hot).groupBy("shard")
    found = cut(shards.applyInArrow(lean(lambda batches: _stars(batches, n_shards, hot)), FOUND), "found")
    sets = found.where("kind = 1").select(F.col("a").alias("doc_id"), "n", "low", "high", "sketch")
    least = sets.where("n > 0").groupBy("n", "low", "high").agg(F.min("doc_id").alias("b"))
    equal = sets.join(least, ["n", "low", "high"]).where("doc_id > b").select(F.col("doc_id").alias("a"), "b")
    packed = found.where("kind = 0").select(F.col("a").alias("sub"), "sketch")
    if len(hot):
        packed = packed.union(_frequent_pairs(found, n_shards))
    star = cut(packed.groupBy("sub").applyInArrow(lean(_count), "a long, b long, n long"), "stars")
    good = cut(_plausible(star, sets, per_cent).join(star, ["a", "b"]), "good")
    texts = involved(table, good.select(F.col("a").alias("doc_id")).union(good.select("b")).distinct())
    # each document and the representative with which it shares most buckets, then the other star pairs
    best = good.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    links = cut(equal.union(verified(texts, best, shingle, per_cent)), "links")
    parts = components(links)
    rest = cut(_apart(good.select("a", "b"), parts).join(best, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = cut(links.union(verified(texts, rest, shingle, per_cent)), "links")
        parts = components(links)
    tried, most = best.union(rest), NEAREST
    member = star.select("a", F.col("b").alias("doc_id")).union(star.select("a", F.col("a").alias("doc_id")).distinct())
    member = member.withColumn("asks", F.lit(None).cast("boolean"))
    while True:
        given, member = _across(member, parts, sets, tried, per_cent, most)
        across = given.where("not more").select("a", "b").distinct()
        if across.isEmpty():
            break
        texts = involved(table, across.select(F.col("a").alias("doc_id")).union(across.select("b")).distinct())
        links = cut(links.union(verified(texts, across, shingle, per_cent)), "links")
        parts = components(links)
        if given.where("more").isEmpty():
            break
        tried, most = tried.union(across), 16 * most
    away, back = apart(kept, "doc_id", "n_shingles", "component_id")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *away).join(sets.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id", "left")
    rows = rows.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rows.select(
        "doc_id",
        *back,
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )
