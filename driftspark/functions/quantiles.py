"""Exact quantiles by distributed selection: rows are counted by ranges, and only the ranges that hold a rank are kept.

One pass finds the size and the ends of every group and column. A range with more than ``LEAF`` rows is then cut into
``CELLS`` cells, all groups and columns in one pass, and the cells that hold the ranks become the next ranges, with the
values that really occur in them as ends; a range whose ends are equal is settled, however many rows it has. What is left
is small, and its distinct values are put into order. Each pass sums before it shuffles, so a group of any size sends a
row a cell and task, and a pass narrows a range by about CELLS: two or three passes, whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.plans.layout import written

CELLS = 4096
#: Rows of a group and column that are put into order in one task at most.
LEAF = 1 << 16
#: Ranges (about 100 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST = 50_000
_HIGH = 1.7976931348623157e308


def values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, column, value: a row per cell that is neither null nor NaN."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), number(c)) for c in columns))
    return df.select(*by, F.inline(cells)).where("value is not null")


def _cell(v: Column, low: Column, high: Column, spread_out: bool) -> Column:
    """A number from 0 to CELLS - 1 that never falls as v rises and differs at the two ends; by magnitude or evenly."""
    inner = lambda x: F.least(F.greatest(x, F.lit(-_HIGH)), F.lit(_HIGH))
    scale = lambda x: F.signum(x) * F.log1p(F.abs(inner(x))) if spread_out else inner(x) / 2
    width = scale(high) - scale(low)
    share = F.when(width > 0, (scale(v) - scale(low)) / width)
    return F.when(v == high, CELLS - 1).otherwise(F.least(F.coalesce(F.floor(share * (CELLS - 1)), F.lit(0)), F.lit(CELLS - 2))).cast("int")


def _on(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on &= a[c].eqNullSafe(b[c])
    return on


def ranked(cells: DataFrame, ranks: DataFrame, key: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """key, rank, value: the value at each rank (from 0) of cells (key, value); ``ranks`` has key, rank, n, low, high (size
    and ends of the key's rows)."""
    names = ["rank", "below", "n", "low", "high"]
    ranges = written(ranks.select(*key, "rank", F.lit(0).cast("long").alias("below"), "n", "low", "high"), "ranges")
    region = [*key, "low", "high"]
    spread_out = True
    while True:
        open_ = (F.col("n") > leaf) & (F.col("low") < F.col("high"))
        n_open = ranges.agg(F.count_if(open_)).first()[0]
        if not n_open:
            break
        wide = ranges.where(open_).select(*region, F.col("below").alias("below0")).distinct()
        small = F.broadcast(wide) if n_open <= BROADCAST else wide
        inside = cells.join(small, _on(cells, small, key) & cells["value"].between(small["low"], small["high"]))
        inside = inside.select(*(small[c] for c in region), "below0", "value", _cell(F.col("value"), small["low"], small["high"], spread_out).alias("cell"))
        counts = inside.groupBy(*region, "below0", "cell").agg(F.count("*").alias("n"), F.min("value").alias("low1"), F.max("value").alias("high1"))
        upto = F.sum("n").over(Window.partitionBy(*region).orderBy("cell"))
        counts = counts.withColumn("below", F.col("below0") + upto - F.col("n")).withColumnsRenamed({c: f"_{c}" for c in [*key, "low", "high", "n", "below"]})
        left = ranges.where(open_)
        same = F.lit(True)
        for c in region:
            same &= left[c].eqNullSafe(counts[f"_{c}"])
        found = left.join(counts, same & (left["rank"] >= counts["_below"]) & (left["rank"] < counts["_below"] + counts["_n"]))
        narrowed = found.select(*key, "rank", F.col("_below").alias("below"), F.col("_n").alias("n"), F.col("low1").alias("low"), F.col("high1").alias("high"))
        ranges = written(ranges.where(~open_).select(*key, *names).unionByName(narrowed), "ranges")
        spread_out = not spread_out
    loose = ranges.where("low < high").select(*region, F.col("below").alias("below0")).distinct()
    small = F.broadcast(loose) if ranges.count() <= BROADCAST else loose
    inside = cells.join(small, _on(cells, small, key) & cells["value"].between(small["low"], small["high"]))
    counts = inside.groupBy(*(small[c] for c in region), "below0", "value").agg(F.count("*").alias("c"))
    end = F.col("below0") + F.sum("c").over(Window.partitionBy(*region).orderBy("value"))
    counts = counts.withColumn("end", end).withColumnsRenamed({c: f"_{c}" for c in region})
    left = ranges.where("low < high")
    same = F.lit(True)
    for c in region:
        same &= left[c].eqNullSafe(counts[f"_{c}"])
    sorted_ = left.join(counts, same & (left["rank"] < counts["end"]) & (left["rank"] >= counts["end"] - counts["c"]))
    settled = ranges.where("low >= high").select(*key, "rank", F.col("low").alias("value"))
    return settled.unionByName(sorted_.select(*key, "rank", "value"))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], *by: str, leaf: int = LEAF) -> DataFrame:
    """by, column, n, mean, std (population), q: the quantiles of each numeric column by linear interpolation between
    neighbouring ranks, over values that are neither null nor NaN. A group without such values has no row."""
    cells = values(df, columns, by)
    key = [*by, "column"]
    ends = written(cells.groupBy(*key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high")), "ends")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    both = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in probabilities))))
    found = ranked(cells, ends.select(*key, F.explode(both).alias("rank"), "n", "low", "high"), key, leaf)
    table = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a quantile
    rows = ends.join(table, _on(ends, table, key)).select(*(ends[c] for c in key), "n", "mean", "std", "at")

    def between(p: float) -> Column:
        low, high = (F.element_at("at", f(place(p))) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place(p) - F.floor(place(p))))

    return rows.select(*key, "n", "mean", "std", F.array(*map(between, probabilities)).alias("q"))
