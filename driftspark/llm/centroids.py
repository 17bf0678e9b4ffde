"""Centroid clustering of integer vectors by exponion search.

Every vector carries its cluster, an upper bound on the distance to that centroid and a lower bound on the distance to
any other one. When centroids have moved, the bounds move by as much. A vector whose upper bound is below its lower bound,
or below half the distance from its centroid to the nearest other one, cannot have changed. Any other vector makes its
upper bound exact and, if that does not settle it, scans only the centroids inside a ball around its own centroid, of
radius twice the upper bound plus the distance to that centroid's nearest neighbour. The ball holds the nearest and the
second nearest centroid; sorted lists of the distances between centroids say how far to go.

Distances are integers and compared as such. Bounds are floating-point numbers that are rounded away from a wrong skip,
and the radius is inclusive, so a tie is always scanned and the smaller number wins.

A round reads the table of vectors and bounds once and writes it once (in shared storage, so that a lost executor costs
a task). Its sums are made in each batch first, so a cluster of any size sends a row a batch; only K centroids are on the
driver and in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import cut, small_batches

K, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Largest component: squared distances of DIMENSIONS components then fit a long.
MOST = 1 << 27
#: Largest component whose distances are exact in floating-point products.
EXACT = 1 << 22
#: Relative slack of bounds, far above their rounding errors.
SLACK = 1e-9

STATE = "vec_id long, v array<int>, cluster int, distance long, upper double, lower double, scanned int"


def scaled(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of vectors that have the dimensions and no null or non-finite component. A component
    beyond MOST (the distances would not fit a long) is an error."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where((F.size("e") == dimensions) & F.forall("e", finite))
    cell = lambda x: F.floor(x * scale)
    within = lambda x: F.when(F.abs(x * scale) < MOST, cell(x).cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {MOST} has distances that no long holds")).cast("int"))
    return rows.select("vec_id", F.transform("e", within).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors with the smallest sha256 of '1:<vec_id>' (equal ones by their components), fewer if there are
    fewer; vectors without an id are none of them."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def squared(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    gap = rows - centroid
    if max(np.abs(rows).max(initial=0), np.abs(centroid).max(initial=0)) <= EXACT:
        gap = gap.astype(float)  # whole numbers below 2 ** 53
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


class Exponion:
    """One round's search: centroids, how far each has moved, and for each the others by distance."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray | None = None):
        self.c, self.k = centroids, len(centroids)
        self.moved = np.zeros(self.k) if moved is None else np.sqrt(moved.astype(float)) * (1 + SLACK)
        apart = np.sqrt(np.stack([squared(centroids, c) for c in centroids]).astype(float)) if self.k else np.zeros((0, 0))
        self.order = [sorted((j for j in range(self.k) if j != a), key=lambda j: apart[a, j]) for a in range(self.k)]  # noqa: B023
        self.apart = [apart[a, self.order[a]] for a in range(self.k)]
        self.nearest = np.array([x[0] if len(x) else np.inf for x in self.apart])
        # the largest move, and for a centroid that made it, the largest of the others
        self.most = np.array([max((m for j, m in enumerate(self.moved) if j != a), default=0.0) for a in range(self.k)])

    def first(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, distance, upper, lower, scanned of rows without bounds: all centroids are scanned."""
        state = _Nearest(len(rows))
        for j in range(self.k):
            state.offer(np.arange(len(rows)), squared(rows, self.c[j]), j)
        return *state.result(), np.full(len(rows), self.k, np.int32)

    def again(self, rows: np.ndarray, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same of rows with the bounds of the last round. ``distance`` is the one at the last scan."""
        upper, lower = upper + self.moved[cluster], np.maximum(lower - self.most[cluster], 0.0)
        cluster, distance, scanned = cluster.copy(), distance.copy(), np.zeros(len(rows), np.int32)
        floor = np.maximum(lower, self.nearest[cluster] / 2) * (1 - SLACK)
        open_ = np.flatnonzero(upper >= floor)
        if len(open_):
            own = self.distance(rows[open_], cluster[open_])
            distance[open_], upper[open_] = own, np.sqrt(own.astype(float)) * (1 + SLACK)
            scanned[open_] = 1
            open_ = open_[upper[open_] >= floor[open_]]
        for a in np.unique(cluster[open_]):
            at = open_[cluster[open_] == a]
            radius = (2 * upper[at] + self.nearest[a]) * (1 + SLACK)
            reach = np.searchsorted(self.apart[a], radius, "right")  # inclusive
            state = _Nearest(len(at))
            state.offer(np.arange(len(at)), distance[at], int(a))
            for i in range(reach.max(initial=0)):
                inside = np.flatnonzero(reach > i)
                state.offer(inside, squared(rows[at[inside]], self.c[self.order[a][i]]), self.order[a][i])
            new, distance[at], upper[at], found = state.result()
            lower[at] = found  # the second nearest is inside the ball
            cluster[at], scanned[at] = new, 1 + reach
        return cluster, distance, upper, lower, scanned

    def distance(self, rows: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for a in np.unique(cluster):
            at = np.flatnonzero(cluster == a)
            out[at] = squared(rows[at], self.c[a])
        return out


class _Nearest:
    """The nearest centroid of each row (ties: the smaller number) and the distance of the second nearest."""

    def __init__(self, n: int):
        self.best, self.number = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int32)
        self.second = np.full(n, np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, distance: np.ndarray, number: int) -> None:
        best, second = self.best[at], self.second[at]
        wins = (distance < best) | ((distance == best) & (number < self.number[at]))
        self.second[at] = np.where(wins, best, np.minimum(second, distance))
        self.best[at] = np.where(wins, distance, best)
        self.number[at] = np.where(wins, number, self.number[at])

    def result(self) -> tuple[np.ndarray, ...]:
        none = self.second == np.iinfo(np.int64).max
        lower = np.where(none, np.inf, np.sqrt(self.second.astype(float)) * (1 - SLACK))
        return self.number, self.best, np.sqrt(self.best.astype(float)) * (1 + SLACK), lower


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dimensions)


def _assigned(vectors: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, dimensions: int, last: bool = False) -> DataFrame:
    """STATE of vectors (vec_id, v, and after the first round the bounds). A vector that is not scanned keeps the distance
    of its last scan, unless this is the last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(centroids, moved)
        for b in batches:
            if b.num_rows:
                rows = _matrix(b, dimensions)
                bounds = [] if moved is None else [b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "distance", "upper", "lower")]
                found = list((search.again if bounds else search.first)(rows, *bounds))
                if last:
                    found[1] = search.distance(rows, found[0])
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], *map(pa.array, found, kinds)], [c.split()[0] for c in STATE.split(", ")])

    return vectors.mapInArrow(run, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; an empty cluster keeps its centroid."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, cluster = _matrix(b, dimensions), b["cluster"].to_numpy(zero_copy_only=False)
                there = np.unique(cluster)
                sums = [rows[cluster == a].sum(axis=0).tolist() for a in there]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.bincount(cluster, minlength=k)[there], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    add = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *add).collect():  # a row a cluster
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dimensions)]
    return out


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance, upper, lower, scanned) and the final centroids: ``rounds`` of assignment and new
    centroids, then a last assignment.

    Defined results: vectors that are null, of other dimensions, or hold a null or non-finite component take no part;
    a vector without an id is clustered, but starts no cluster; rows that share an id are vectors of their own; ties go
    to the smaller number, so of equal centroids the later ones stay empty and where they are; fewer vectors than k give
    fewer clusters; an empty table, or one without ids, gives no rows; further columns, whatever their names, are not
    read."""
    small_batches(embeddings.sparkSession)
    vectors = cut(scaled(embeddings, dimensions, scale), "vectors")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return vectors.where("false").selectExpr("vec_id", "v", *(f"cast(null as {t}) as {c}" for c, t in (x.split() for x in STATE.split(", ")[2:]))), centroids
    state, moved = vectors, None
    for i in range(rounds):
        state = cut(_assigned(state, centroids, moved, dimensions), f"round{i}")
        old, centroids = centroids, _means(state, centroids)
        moved = np.array([squared(old[[a]], centroids[a])[0] for a in range(len(old))])
    return cut(_assigned(state, centroids, moved, dimensions, last=True), "last"), centroids


def inertia(state: DataFrame) -> dict[int, int]:
    """Sum of the squared distances of each cluster (k numbers at most)."""
    return {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}


def text_of(centroids: np.ndarray, cluster_: Column) -> Column:
    """A cluster's final centroid as decimal integers joined by commas (k strings in the plan)."""
    names = [F.lit(",".join(map(str, c.tolist()))) for c in centroids]
    return F.element_at(F.array(*names), cluster_ + 1) if names else F.lit(None).cast("string")
