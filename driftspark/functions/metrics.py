"""Ranking and threshold metrics as grouped aggregates.

Thresholds are distinct scores in descending order. Scores fall into bins, running sums are taken inside a bin and the
bins' totals (at most ``BINS`` rows a group) are added, so no task sorts all scores of a group. The bins' borders come
from a sketch of the distinct scores and hold about equally many of them, wherever the scores crowd; sums are exact for
any borders. Three null rules exist
and are separate functions: one class gives null (``ranking``), fewer than two rows or classes gives null
(``safe_ap``), no positive gives 0 (``slice_ap``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.quantiles import quantiles
from driftspark.plans.layout import written

BINS = 256


def borders(cells: DataFrame, score: str = "score") -> list[float]:
    """Up to BINS - 1 scores between which about equally many distinct scores of all groups lie."""
    q = F.percentile_approx(F.col(score).cast("double"), F.array(*(F.lit(i / BINS) for i in range(1, BINS))), F.lit(10 * BINS))
    return sorted(set(cells.select(score).distinct().agg(q).first()[0] or []))


def bin_of(score: Column, edges: list[float]) -> Column:
    """How many borders a score is not below: a search by halves, log2(BINS) comparisons."""
    if not edges:
        return F.lit(0)
    table, steps, n = F.array(*map(F.lit, edges)), [1 << k for k in reversed(range(len(edges).bit_length()))], len(edges)
    forward = lambda i, d: F.when((i + d <= n) & (F.get(table, i + d - 1) <= score), i + d).otherwise(i)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), forward)


def thresholds(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """One row per group and distinct score: _p, _n (positives and negatives at it), _tp, _k (positives, rows at
    or above it), _pos, _rows (of the group)."""
    cells = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_c")
    )
    cells = written(cells, "cells")  # read for the borders, the totals and the running sums
    cells = cells.where("score is not null").withColumn("_bin", bin_of(F.col("score"), borders(cells)))
    totals = cells.groupBy(*by, "_bin").agg(F.sum("_p").alias("_bp"), F.sum("_c").alias("_bc"))
    above = Window.partitionBy(*by).orderBy(F.desc("_bin"))
    earlier = above.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    totals = totals.select(
        *by,
        "_bin",
        F.coalesce(F.sum("_bp").over(earlier), F.lit(0)).alias("_tp0"),
        F.coalesce(F.sum("_bc").over(earlier), F.lit(0)).alias("_k0"),
        F.sum("_bp").over(group).alias("_pos"),
        F.sum("_bc").over(group).alias("_rows"),
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("_tp_in", F.sum("_p").over(inside)).withColumn("_k_in", F.sum("_c").over(inside))
    on = [run[c].eqNullSafe(totals[c]) for c in by] + [run["_bin"] == totals["_bin"]]
    return run.join(F.broadcast(totals) if not by else totals, on).select(
        *(run[c] for c in by),
        "score",
        "_p",
        (F.col("_c") - F.col("_p")).alias("_n"),
        (F.col("_tp0") + F.col("_tp_in")).alias("_tp"),
        (F.col("_k0") + F.col("_k_in")).alias("_k"),
        "_pos",
        "_rows",
    )


def _ap() -> Column:
    return F.sum(F.col("_p") / F.nullif(F.col("_pos"), F.lit(0)) * F.col("_tp") / F.col("_k"))


def ranking(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """n_samples, n_positive, pr_auc (average precision), roc_auc (ties count half); null where only one class occurs."""
    t = thresholds(df, *by, score=score, y=y)
    pos, neg = F.max("_pos"), F.max("_rows") - F.max("_pos")
    area = F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") + F.col("_p") / 2.0))
    both = (pos > 0) & (neg > 0)
    return t.groupBy(*by).agg(
        F.max("_rows").alias("n_samples"),
        pos.alias("n_positive"),
        F.when(both, _ap()).alias("pr_auc"),
        F.when(both, area / F.nullif(pos * neg, F.lit(0))).alias("roc_auc"),
    )


def safe_ap(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """ap, n: null with fewer than two rows or classes."""
    t = thresholds(df, *by, score=score, y=y)
    both = (F.max("_pos") > 0) & (F.max("_rows") > F.max("_pos"))
    return t.groupBy(*by).agg(F.when(both, _ap()).alias("ap"), F.max("_rows").alias("n"))


def slice_ap(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """ap, n: 0 without a positive, rounded to 6 digits."""
    t = thresholds(df, *by, score=score, y=y)
    return t.groupBy(*by).agg(F.round(F.coalesce(_ap(), F.lit(0.0)), 6).alias("ap"), F.max("_rows").alias("n"))


def trapezoid_ap(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """Area under the precision-recall polygon from (recall 0, precision 1); 0 where only one class occurs; 5 digits."""
    t = thresholds(df, *by, score=score, y=y)
    before = F.when(F.col("_k") - F.col("_p") - F.col("_n") > 0, (F.col("_tp") - F.col("_p")) / F.nullif(F.col("_k") - F.col("_p") - F.col("_n"), F.lit(0))).otherwise(F.lit(1.0))
    step = F.col("_p") / F.nullif(F.col("_pos"), F.lit(0)) * (F.col("_tp") / F.col("_k") + before) / 2.0
    both = (F.max("_pos") > 0) & (F.max("_rows") > F.max("_pos"))
    return t.groupBy(*by).agg(F.round(F.when(both, F.sum(step)).otherwise(F.lit(0.0)), 5).alias("pr_auc"), F.max("_rows").alias("n"))


def decision(prob: str | Column = "y_prob", cut: float = 0.5) -> Column:
    return (F.col(prob) >= cut).cast("int") if isinstance(prob, str) else (prob >= cut).cast("int")


def confusion(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, f2 at 0.5; 0 where a ratio has no denominator."""
    hat, real = decision(score) == 1, F.col(y) == 1
    c = df.groupBy(*by).agg(
        F.count_if(hat & real).alias("tp"),
        F.count_if(hat & ~real).alias("fp"),
        F.count_if(~hat & real).alias("fn"),
        F.count_if(~hat & ~real).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by, "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"),
    )


def snapshot(df: DataFrame, *by: str, score: str = "y_prob", y: str = "y") -> DataFrame:
    """Ranking and threshold metrics in one row per group."""
    r, c = ranking(df, *by, score=score, y=y), confusion(df, *by, score=score, y=y)
    return r.join(c, list(by)) if by else r.crossJoin(F.broadcast(c))  # one row each


def latency_percentiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    """n, mean, p50, p95, p99 by linear interpolation, exact (``quantiles``); no row for a group without a value."""
    out = quantiles(df, [column], (0.5, 0.95, 0.99), *by)
    return out.select(*by, "n", "mean", *(F.get("q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p95", "p99"))))
