"""Exact top-k search by inner product over KD-trees, one per shard.

Each component x of a vector becomes floor(64 * x). A shard of candidates builds a tree by median splits of the widest
dimension, with a tight bounding box for every node. A query visits a tree best first: the largest inner product with a
box, the sum of the larger of q * low and q * high, bounds what the box can hold, and nodes whose bound is below the kth
score so far stay closed (equal bounds are opened, as ties go to smaller ids).

Queries travel in blocks. A block first visits one home shard; the kth scores found there go with it to all other
shards, so that these open only what can still matter, and send only scores that reach the kth. Shards and blocks have a
fixed number of rows. A shard stays in one task, which builds its tree once and answers block after block as they come,
so memory holds one tree and one block, and what travels is each shard twice and each block once for every shard.

Defined results: a vector that is null or empty, holds a null or non-finite component, or has a null vec_id takes no
part; vectors of different lengths are not compared; rows that share the query's vec_id are its own; repeated candidates
count repeatedly; sums are exact whatever the components' size, and a scaled component or a score beyond the range of a
long counts as the nearest long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm._common import cut, lean

K = 20
SHARD_ROWS = 16384
BLOCK_ROWS = 1024
LEAF = 256
_LOW, _HIGH = -(2**63), 2**63 - 1


class Tree:
    """Median splits down to leaves; ``low`` and ``high`` are the boxes of the nodes, ``span`` the rows of each.

    Rows are 64-bit integers. ``use`` chooses the numbers to count with: doubles where they are exact, else 64-bit
    integers, else Python's."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(rows))
        low, high, span, child = [], [], [], []

        def build(a: int, b: int) -> int:
            part = rows[order[a:b]]
            node = len(span)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            span.append((a, b))
            child.append(())
            if b - a > leaf:
                d = int(np.argmax(high[node].astype(float) - low[node]))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                child[node] = (build(a, a + mid), build(a + mid, b))
            return node

        build(0, len(rows))
        self.ids, self.span, self.child = ids[order], span, child
        self.whole = (rows[order], np.array(low), np.array(high))
        self.most = max(abs(int(self.whole[1].min())), abs(int(self.whole[2].max())))
        self.typed: dict = {}

    def use(self, queries: np.ndarray) -> np.ndarray:
        """The queries in the numbers that their products with this tree need."""
        reach = max(abs(int(queries.min())), abs(int(queries.max()))) * self.most * queries.shape[1]
        kind = np.float64 if reach < 1 << 52 else np.int64 if reach < 1 << 63 else object
        if kind not in self.typed:
            self.typed = {kind: [x.astype(kind) for x in self.whole]}
        self.rows, self.low, self.high = self.typed[kind]
        return queries.astype(kind)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest possible inner product of each query (row) with each node (column)."""
        return within(np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T)

    def search(self, own: int, query: np.ndarray, bound: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the k best rows of the tree with a score of ``least`` or more, in no order."""
        best: list[tuple[int, int]] = []  # min-heap of (score, -vec_id)
        kth = least
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heappop(heap)
            if -b < kth:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= kth:
                        heappush(heap, (-bound[c], c))
                continue
            a, e = self.span[node]
            scores = within(self.rows[a:e] @ query)
            at = np.flatnonzero(scores >= kth)
            for s, i in zip(scores[at].tolist(), self.ids[a:e][at].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heappush(best, (int(s), -i))
                else:
                    heappushpop(best, (int(s), -i))
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def within(scores: np.ndarray) -> np.ndarray:
    """Scores in the range of a long; only Python's integers can leave it."""
    return np.minimum(np.maximum(scores, _LOW), _HIGH) if scores.dtype == object else scores


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, v (array of longs) of the vectors that take part."""
    whole = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    whole = whole.withColumn("e", F.transform("e", lambda c: c.cast("double")))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = whole.where("vec_id is not null and size(e) > 0").where(F.forall("e", fine))
    return whole.select("vec_id", F.size("e").alias("dim"), F.transform("e", lambda c: F.floor(c * 64).cast("long")).alias("v"))


BLOB = "dim int, part int, ids binary, data binary"


def _packed(rows: DataFrame, part) -> DataFrame:
    """Vectors in blobs, one per (dim, part)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        first = got[0]
        ids = np.concatenate([b.column("vec_id").to_numpy(zero_copy_only=False) for b in got])
        data = np.concatenate([b.column("v").flatten().to_numpy(zero_copy_only=False) for b in got])
        data = data.astype("<i4" if -(2**31) <= data.min() and data.max() < 2**31 else "<i8")
        yield pa.RecordBatch.from_arrays(
            [
                first.column("dim")[:1],
                first.column("part")[:1],
                pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                pa.array([data.tobytes()], pa.binary()),
            ],
            names=["dim", "part", "ids", "data"],
        )

    return rows.select("dim", part.cast("int").alias("part"), "vec_id", "v").groupBy("dim", "part").applyInArrow(lean(pack), BLOB)


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    wide = len(row["data"]) == 8 * len(ids) * row["dim"]
    return ids, np.frombuffer(row["data"], "<i8" if wide else "<i4").reshape(len(ids), row["dim"]).astype(np.int64)


CELL = "dim int, part int, ids binary, data binary, kth binary, is_query boolean, shard int, block int"
FOUND = "dim int, block int, ids binary, data binary, kth binary, query_id long, vec_id long, score long"


def _answer(block: dict, tree: Tree | None, k: int, carry: bool) -> pa.RecordBatch:
    """What a block finds in a shard's tree, and with ``carry`` the block again, with its kth scores."""
    ids, queries = _arrays(block)
    kth = np.frombuffer(block["kth"], "<i8").copy() if block["kth"] else np.full(len(ids), _LOW, np.int64)
    found: list[tuple[int, int, int]] = []
    if tree is not None:
        queries = tree.use(queries)
        bounds = tree.bounds(queries)
        for n, (own, q) in enumerate(zip(ids.tolist(), queries, strict=True)):
            best = tree.search(own, q, bounds[n], k, int(kth[n]))
            found += [(own, i, s) for s, i in best]
            if len(best) == k:
                kth[n] = max(int(kth[n]), min(s for s, _ in best))
    n = len(found)
    q, i, s = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
    if carry:
        blob = [block["dim"], block["block"], block["ids"], block["data"], kth.astype("<i8").tobytes()]
        columns = [[x] + [None] * n for x in blob] + [[None] + q, [None] + i, [None] + s]
    else:
        columns = [[None] * n] * 5 + [q, i, s]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _visit(cells: DataFrame, n_shards: int, k: int, carry: bool) -> DataFrame:
    """Searches each shard for its blocks. The shard's own row comes first, then its blocks, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n].as_py() for c in b.schema.names}
                if (row["dim"], row["shard"]) != at:
                    at, tree = (row["dim"], row["shard"]), None
                if row["is_query"]:
                    yield _answer(row, tree, k, carry)
                else:
                    tree = Tree(*_arrays(row))

    dealt = cells.repartition(2 * n_shards, "dim", "shard").sortWithinPartitions("dim", "shard", "is_query", "block")
    return dealt.mapInArrow(lean(run), FOUND)


def top_k(embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id."""
    table = scaled(embeddings)
    sizes = table.agg(F.count("*"), F.count_if(is_query)).first()
    n_shards, n_blocks = max(1, -(-sizes[0] // SHARD_ROWS)), max(1, -(-sizes[1] // BLOCK_ROWS))
    hashed = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    shards = cut(_packed(table, hashed(1, n_shards)), "shards")
    blocks = cut(_packed(table.where(is_query), hashed(2, n_blocks)), "blocks")
    none = F.lit(None).cast("binary")

    members = shards.select("dim", "part", "ids", "data", none.alias("kth"), F.lit(False).alias("is_query"), F.col("part").alias("shard"), F.lit(-1).alias("block"))

    def cells(queries: DataFrame, visits) -> DataFrame:
        """The shards, and each block once for every shard that it visits."""
        left = queries.select("dim", "part", "ids", "data", "kth", F.lit(True).alias("is_query"), F.explode(visits).alias("shard"), F.col("part").alias("block"))
        return members.union(left)

    home = F.pmod("part", F.lit(n_shards)).cast("int")
    first = cut(_visit(cells(blocks.withColumn("kth", none), F.array(home)), n_shards, k, carry=True), "home")
    found = first.where("query_id is not null").select("query_id", "vec_id", "score")
    if n_shards > 1:
        carried = first.where("block is not null").select("dim", F.col("block").alias("part"), "ids", "data", "kth")
        others = F.filter(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: s != home)
        found = found.union(_visit(cells(carried, others), n_shards, k, carry=False).select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
