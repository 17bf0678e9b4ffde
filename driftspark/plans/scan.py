"""Distributed prefix scan: running values of any associative function over a table with a dense index.

Rows are cut into blocks of neighbouring indices. A window runs inside each block, every block's total is one row, and the
totals' own exclusive prefix, which is a scan of a table ``chunk`` times smaller, is added to the block's rows. So no task
sees more than a block, whatever the number of rows, and the big side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.plans.layout import CHUNK, with_index


@dataclass(frozen=True)
class Fold:
    """An associative function: the total of many values (given their index), and of two totals, either of them null."""

    total: Callable[[Column, Column], Column]
    both: Callable[[Column, Column], Column]


SUM = Fold(lambda v, i: F.sum(v), lambda a, b: F.coalesce(a + b, a, b))
MAX = Fold(lambda v, i: F.max(v), lambda a, b: F.greatest(a, b))
MIN = Fold(lambda v, i: F.min(v), lambda a, b: F.least(a, b))
#: The latest value that is not null.
LAST = Fold(lambda v, i: F.max_by(v, F.when(v.isNotNull(), i)), lambda a, b: F.coalesce(b, a))


def running(df: DataFrame, folds: dict[str, tuple[Fold, Column]], *by: str, index: str = "tx_index", inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Adds running values in the order of ``index`` (dense, or nearly), within ``by`` if given; without the row itself if
    not ``inclusive``. A running value before any other is null."""
    names = {n: f"_v{i}" for i, n in enumerate(folds)}
    valued = df.select("*", *(c.alias(names[n]) for n, (_, c) in folds.items()))
    top = df.agg(F.max(index)).first()[0] or 0
    out = _level(valued, {n: f for n, (f, _) in folds.items()}, names, list(by), index, int(top), inclusive, chunk)
    return out.drop(*names.values())


def _level(df: DataFrame, folds: dict[str, Fold], names: dict[str, str], by: list[str], index: str, top: int, inclusive: bool, chunk: int) -> DataFrame:
    block = f"_block_{index}"
    df = df.withColumn(block, F.floor(F.col(index) / chunk))
    w = Window.partitionBy(block, *by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    total = {n: f.total(F.col(names[n]), F.col(index)) for n, f in folds.items()}
    inside = df.select("*", *(c.over(w).alias(n) for n, c in total.items()))
    if top < chunk:
        return inside.drop(block)
    sums = df.groupBy(block, *by).agg(*(c.alias(names[n]) for n, c in total.items()))
    before = _level(sums, folds, names, by, block, top // chunk, False, chunk).select(block, *by, *(F.col(n).alias(f"_before{i}") for i, n in enumerate(folds)))
    on = inside[block] == before[block]
    for c in by:
        on &= inside[c].eqNullSafe(before[c])
    both = inside.join(before.select(*(before[c] for c in before.columns)), on, "left")
    kept = [inside[c] for c in inside.columns if c not in folds and c != block]
    return both.select(*kept, *(f.both(F.col(f"_before{i}"), inside[n]).alias(n) for i, (n, f) in enumerate(folds.items())))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    direction: str = "forward",
    exact: bool = True,
    ties: Sequence[str] = (),
    within: float | None = None,
    name: str = "found",
    chunk: int = CHUNK,
) -> DataFrame:
    """Each left row with the right row whose key ``on`` is next to its own, as a struct ``name`` of all right columns.

    ``forward`` takes the smallest key that is not below the left one, ``backward`` the largest that is not above it; with
    ``exact`` false, equal keys do not count, and ``within`` bounds the distance. Of right rows with equal keys the first
    by ``ties`` counts. ``by`` has to be equal (null is a value like any other). Null keys have no partner. Every left row
    comes back once, repeated ones too.

    One table of both sides is put into order, and the latest right row is carried along as a running value, across any
    number of partitions: no inequality join, and a hot value of ``by`` is spread over blocks like all else."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction is forward or backward")
    names = list(dict.fromkeys([*by, on]))
    whole, carried = F.struct(*(F.col(f"`{c}`") for c in left.columns)), F.struct(*(F.col(f"`{c}`") for c in right.columns))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*ties)) if ties else None
    right = right.where(F.col(on).isNotNull())
    if rank is not None:
        right = right.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)]
    # at equal keys the right rows come first where they count
    sides = (1, 0) if exact else (0, 1)
    a = left.select(*keys, F.lit(sides[0]).alias("_side"), whole.alias("_left"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("_right"))
    b = right.select(*keys, F.lit(sides[1]).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), carried.alias("_right"))
    key = f"_k{names.index(on)}"
    group = [f"_k{i}" for i, c in enumerate(names) if c in by]
    order = [*group, F.col(key).asc() if direction == "backward" else F.col(key).desc(), F.col("_side")]
    placed = with_index(a.unionByName(b), *order, name="_at")
    carry = running(placed, {"_found": (LAST, F.col("_right"))}, *group, index="_at", chunk=chunk).where("_left is not null")
    near = F.col(key).isNotNull() & F.col("_found").isNotNull()
    if within is not None:
        near &= F.abs(F.col("_found").getField(on) - F.col(key)) <= within
    return carry.select("_left.*", F.when(near, F.col("_found")).alias(name))
