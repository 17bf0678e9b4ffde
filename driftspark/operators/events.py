"""Event-centred metrics of a run: what happens around a drift onset, composed from the grouped metrics.

``index_origin`` tells how records count: "stream" (records are moved to 0-based stream positions, which is what a
drift onset counts in) or "global" (record indices are compared with the onset as they are).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.functions.metrics import safe_ap, slice_ap, trapezoid_ap
from driftspark.plans.layout import prefixes, strided
from driftspark.plans.scan import asof_join


def placed(records: DataFrame, warmup: int, index_origin: str = "stream") -> DataFrame:
    if index_origin not in ("stream", "global"):
        raise ValueError("index_origin is stream or global")
    return records.withColumn("pos", F.col("tx_index") - (warmup if index_origin == "stream" else 0))


def phase(t: int, horizon: int, pos: str = "pos") -> Column:
    """'pre' in [t - horizon, t), 'post' in [t, t + horizon), else null: one scan serves both."""
    p = F.col(pos)
    return F.when((p >= max(0, t - horizon)) & (p < t), "pre").when((p >= t) & (p < t + horizon), "post")


def pre_post_ap(records: DataFrame, t: int, horizon: int) -> DataFrame:
    """One row: pre_ap, post_ap, delta (5 digits), n_pre, n_post."""
    ap = safe_ap(records.withColumn("phase", phase(t, horizon)).where("phase is not null"), "phase")
    of = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    one = ap.agg(of("pre", "ap").alias("a"), of("post", "ap").alias("b"), of("pre", "n").alias("x"), of("post", "n").alias("y"))
    return one.select(
        F.round("a", 5).alias("pre_ap"),
        F.round("b", 5).alias("post_ap"),
        F.round(F.col("b") - F.col("a"), 5).alias("delta"),
        F.coalesce("x", F.lit(0)).alias("n_pre"),
        F.coalesce("y", F.lit(0)).alias("n_post"),
    )


def degradation_slope(records: DataFrame, t: int, horizon: int, n_post: int, place: str | None = None) -> DataFrame:
    """One row: least-squares slope (8 digits) of the average precision of expanding prefixes of the post slice against
    the position of each prefix's last row; null below 200 rows, 3 points, or without spread.

    ``place`` numbers the rows of the slice from 0; without it they are taken to follow each other."""
    step = max(50, n_post // 20)
    post = records.withColumn("i", F.col(place) if place else F.col("pos") - t).where((F.col("pos") >= t) & (F.col("pos") < t + horizon))
    spread_out = prefixes(post, step, n_post, "i")
    last = spread_out.groupBy("k").agg(F.max(F.col("pos") - t).cast("double").alias("x"))
    ap = safe_ap(spread_out, "k").where("ap is not null").join(F.broadcast(last), "k")  # at most 20 prefixes or one for 50 rows
    spread = F.regr_sxx("ap", "x")
    fine = (F.count("*") >= 3) & (spread > 1e-12) & F.lit(n_post >= 200)
    return ap.agg(F.round(F.when(fine, F.regr_slope("ap", "x")), 8).alias("slope"))


def detection(alarms: DataFrame, t: int, pos: str = "pos") -> DataFrame:
    """One row: false_alarms before the onset, first alarm at or after it, delay."""
    p = F.col(pos)
    first = F.min(F.when(p >= t, p))
    return alarms.agg(F.count_if(p < t).alias("false_alarms"), first.alias("first_alarm"), (first - t).alias("delay"))


def detections(onsets: DataFrame, alarms: DataFrame, by: tuple[str, ...] = ("segment_key",), pos: str = "pos") -> DataFrame:
    """by, onset, first_alarm, delay of many onsets at once: the first alarm of the same ``by`` at or after each onset, or
    null. An as-of join, so neither side has to fit anywhere."""
    found = asof_join(onsets.select(*by, pos), alarms.select(*by, pos), pos, by)
    first = F.col("found").getField(pos)
    return found.select(*by, F.col(pos).alias("onset"), first.alias("first_alarm"), (first - F.col(pos)).alias("delay"))


def recovery_time(records: DataFrame, t: int, horizon: int, n_post: int, window: int, pre_ap: float | None, tolerance: float = 0.05) -> DataFrame:
    """One row: the first position (from the onset) whose trailing window inside the post slice has recovered. The slice
    has at most ``horizon`` rows, so one task goes through it and holds one window."""
    post = records.where((F.col("pos") >= t) & (F.col("pos") < t + horizon)).select("pos", "y_prob", "y")
    none = F.lit(None).cast("long").alias("recovery")
    if pre_ap is None or n_post < window:
        return records.sparkSession.range(1).select(none)
    goal = pre_ap - tolerance

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        score, y, pos = pdf["y_prob"].to_numpy(float), pdf["y"].to_numpy(), pdf["pos"].tolist()
        for end in range(window, len(pdf) + 1):
            ap = plain_ap(y[end - window : end], score[end - window : end])
            if ap is not None and ap >= goal:
                return pd.DataFrame({"recovery": [pos[end - 1] - t]})
        return pd.DataFrame({"recovery": pd.Series([], dtype="int64")})

    found = post.groupBy(F.lit(0).alias("slice")).applyInPandas(scan, "recovery long")
    return found.agg(F.min("recovery").alias("recovery"))


def plain_ap(y: np.ndarray, score: np.ndarray) -> float | None:
    """Average precision of a few rows; null with fewer than two rows or classes."""
    n_pos = int(y.sum())
    if len(y) < 2 or not 0 < n_pos < len(y):
        return None
    order = np.argsort(-score, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(score[order]) != 0, True))
    hits = np.cumsum(y[order])[ends]
    return float((np.diff(hits, prepend=0) / n_pos * hits / (ends + 1)).sum())


def trajectory(records: DataFrame, n: int, window: int = 5000, max_points: int = 150, index: str = "i") -> DataFrame:
    """k, pr_auc, n: rolling trapezoidal area at max_points steps."""
    return trapezoid_ap(strided(records, window, max(1, n // max_points), n, index), "k")


def adaptations_after(adaptations: DataFrame, t: int, pos: str = "pos") -> DataFrame:
    """One row: number and total duration of adaptations at or after the onset."""
    late = F.col(pos) >= t
    return adaptations.agg(F.count_if(late).alias("n_adaptations"), F.coalesce(F.sum(F.when(late, F.col("duration_s"))), F.lit(0.0)).alias("duration_s"))


def horizons(records: DataFrame, triggers: DataFrame, horizon: int) -> DataFrame:
    """trigger, pre_ap, post_ap, delta (6 digits), n_pre, n_post, complete: records strictly before and after triggers.

    Records meet the triggers whose neighbourhood they are in by bucket of ``horizon``, an equi-join."""
    cell = lambda c: F.floor(c / horizon)
    near = triggers.select(F.col("tx_index").alias("trigger"), F.explode(F.sequence(cell(F.col("tx_index")) - 1, cell(F.col("tx_index")) + 1)).alias("cell"))
    both = records.withColumn("cell", cell(F.col("tx_index"))).join(near, "cell")
    gap = F.col("tx_index") - F.col("trigger")
    side = F.when((gap < 0) & (gap >= -horizon), "pre").when((gap > 0) & (gap <= horizon), "post")
    ap = slice_ap(both.withColumn("side", side).where("side is not null"), "trigger", "side")
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    got = ap.groupBy("trigger").agg(of("pre", "ap").alias("pre_ap"), of("post", "ap").alias("post_ap"), of("pre", "n").alias("x"), of("post", "n").alias("y"))
    out = triggers.select(F.col("tx_index").alias("trigger")).join(got, "trigger", "left")
    return out.select(
        "trigger",
        "pre_ap",
        "post_ap",
        F.round(F.col("post_ap") - F.col("pre_ap"), 6).alias("delta"),
        F.coalesce("x", F.lit(0)).alias("n_pre"),
        F.coalesce("y", F.lit(0)).alias("n_post"),
        (F.coalesce("y", F.lit(0)) == horizon).alias("complete"),
    )
