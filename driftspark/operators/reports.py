"""Result tables over runs, jobs and datasets: event-centred metrics as one row, summaries, logs, and chart tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.functions.metrics import safe_ap
from driftspark.operators.events import adaptations_after, degradation_slope, detection, phase, placed, recovery_time
from driftspark.operators.profile import missing
from driftspark.plans.layout import with_index

# --- events -----------------------------------------------------------------------------------------------------


def event_metrics(
    records: DataFrame,
    alarms: DataFrame,
    adaptations: DataFrame,
    regime: str,
    t: int,
    horizon: int = 5000,
    recovery_window: int = 1000,
    recovery_tolerance: float = 0.05,
    segment: str | None = None,
    warmup: int = 0,
    index_origin: str = "stream",
) -> DataFrame:
    """One row: average precision before, after and over the whole stream, their difference, degradation slope,
    detection delay, false alarms, recovery time, and adaptations after the onset.

    ``segment`` restricts records to a segment, and alarms (tx_index, segment_key) to it and to global ones (null key).
    Only the two slices of ``horizon`` rows are ever numbered or sorted in one task."""
    if segment is not None:
        records = records.where(F.col("segment_key") == segment)
        alarms = alarms.where(F.col("segment_key").isNull() | (F.col("segment_key") == segment))
    records, alarms, adaptations = (placed(x, warmup, index_origin) for x in (records, alarms, adaptations))
    around = safe_ap(records.withColumn("phase", phase(t, horizon)).where("phase is not null"), "phase")
    found = {r["phase"]: (r["ap"], r["n"]) for r in around.collect()}  # two rows at most
    (pre, n_pre), (post, n_post) = found.get("pre", (None, 0)), found.get("post", (None, 0))
    after = records.where((F.col("pos") >= t) & (F.col("pos") < t + horizon))
    # rows of the slice are numbered by their place in it, which a segment's positions are not
    after = with_index(after, "pos", name="i")
    whole = safe_ap(records).agg(F.max("ap").alias("full"))
    one = whole.crossJoin(F.broadcast(degradation_slope(after, t, horizon, n_post, "i")))
    one = one.crossJoin(F.broadcast(detection(alarms, t))).crossJoin(F.broadcast(adaptations_after(adaptations, t)))
    back = recovery_time(after, t, horizon, n_post, recovery_window, pre, recovery_tolerance)
    digits = lambda x: F.lit(None if x is None else round(x, 5)).cast("double")
    delta = None if pre is None or post is None else post - pre
    return one.crossJoin(F.broadcast(back)).select(
        F.lit(regime).alias("regime"),
        F.lit(t).cast("long").alias("t_drift"),
        F.lit(horizon).cast("long").alias("horizon"),
        digits(pre).alias("pre_drift_pr_auc"),
        digits(post).alias("post_drift_pr_auc"),
        digits(delta).alias("delta_pr_auc"),
        F.col("slope").alias("degradation_slope"),
        F.col("delay").alias("detection_delay"),
        F.col("false_alarms").alias("false_alarms_before_drift"),
        F.col("recovery").alias("recovery_time"),
        F.col("n_adaptations").alias("adaptation_count_post_drift"),
        F.col("duration_s").alias("total_retrain_time_post_s"),
        F.round("full", 5).alias("full_stream_pr_auc"),
        F.lit(n_pre).cast("long").alias("n_pre_samples"),
        F.lit(n_post).cast("long").alias("n_post_samples"),
        F.lit(segment).cast("string").alias("segment_evaluated"),
    )


def horizon_means(events: DataFrame) -> DataFrame:
    """One row over events with pre_ap, post_ap, delta: their means over non-null values, and how often delta is a drop."""
    drops, n = F.count_if(F.col("delta") < 0), F.count("delta")
    return events.agg(
        F.count("*").alias("n_events"), F.avg("pre_ap").alias("mean_pre"), F.avg("post_ap").alias("mean_post"),
        F.avg("delta").alias("mean_delta"), drops.alias("n_drops"), (drops / F.nullif(n, F.lit(0))).alias("drop_share"),
    )


def drift_counts(events: DataFrame, key: str = "stream_key") -> DataFrame:
    """stream_key, n: drift events per stream key (inspection of a monitor's log)."""
    return events.groupBy(F.col(key).alias("stream_key")).agg(F.count("*").alias("n"))


def drift_state(events: DataFrame, key: str = "stream_key") -> DataFrame:
    """One row: whether a global and whether a segment alarm occurred, and the keys in order of their first alarm."""
    part = F.col(key) != "global"
    first = events.where(part).groupBy(key).agg(F.min("tx_index").alias("at"))
    names = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", key))), lambda x: x[key]).alias("segments"))
    flags = events.agg(F.coalesce(F.bool_or(~part), F.lit(False)).alias("global_drift_detected"), F.coalesce(F.bool_or(part), F.lit(False)).alias("segment_drift_detected"))
    return flags.crossJoin(F.broadcast(names))


def known_segments(records: DataFrame, key: str = "segment_key") -> DataFrame:
    """segment_key: distinct non-null segments in order."""
    return records.select(F.col(key).alias("segment_key")).where("segment_key is not null").distinct().orderBy("segment_key")


# --- runs -------------------------------------------------------------------------------------------------------


def adaptation_log(records: DataFrame, policy: str, interval: int = 10_000) -> DataFrame:
    """policy, tx_index, scope, duration_s, trigger, adaptation_event_index, trigger_occurred, replacement_performed of
    the records of one run whose policy was due. Retrains are few: one for ``interval`` rows or for an alarm."""
    scope = F.col("adaptation_scope")
    #: The texts of the triggers.
    trigger = {
        "P1": F.lit(f"P1:periodic:every_{interval}_tx"),
        "P2": F.lit("P2:global_drift_detected"),
        "P3": F.concat(F.lit("P3:segment_drift:"), scope),
    }.get(policy, F.lit(None).cast("string"))
    duration = F.when(F.col("adapted"), F.col("duration_s")).otherwise(0.0) if "duration_s" in records.columns else F.lit(None).cast("double")
    due = with_index(records.where(scope.isNotNull()), "tx_index", name="adaptation_event_index")
    return due.select(
        F.lit(policy).alias("policy"), "tx_index", scope.alias("scope"), duration.alias("duration_s"), trigger.alias("trigger"),
        F.col("adaptation_event_index").cast("long").alias("adaptation_event_index"),
        F.lit(True).alias("trigger_occurred"), F.col("adapted").alias("replacement_performed"),
    )


def adaptation_totals(log: DataFrame, *by: str) -> DataFrame:
    """n_adaptations, total_s."""
    return log.groupBy(*by).agg(F.count("*").alias("n_adaptations"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("total_s"))


def throughput(n_rows: Column, seconds: Column) -> Column:
    """Streamed rows a second, 0 without time; the seconds include warmup, the rows do not."""
    return F.when(seconds > 0, n_rows / F.nullif(seconds, F.lit(0))).otherwise(0.0)


def milliseconds(seconds: Column, ready: Column) -> Column:
    """A latency in ms (4 digits): the one that is in ms already, else from seconds."""
    return F.round(F.coalesce(ready, seconds * 1000.0, F.lit(0.0)), 4)


def run_summary(metrics: DataFrame, log: DataFrame, alarms: DataFrame, latency: DataFrame, run: dict) -> DataFrame:
    """One row from one-row frames: ``metrics`` (snapshot), ``latency`` (p95) and the counts of a log and alarms; ``run``
    names policy, detector_type, n_warmup, n_stream and total_wall_time_s."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = metrics.select("pr_auc", "roc_auc", "f1", "recall").crossJoin(F.broadcast(latency.select(F.col("p95").alias("latency_p95_s"))))
    one = one.crossJoin(F.broadcast(count(log, "n_adaptations"))).crossJoin(F.broadcast(count(alarms, "n_drift_events")))
    keys = ("policy", "detector_type", "n_warmup", "n_stream", "total_wall_time_s")
    rate = throughput(F.col("n_stream"), F.col("total_wall_time_s")).alias("throughput_tx_per_sec")
    return one.select(*(F.lit(run[k]).alias(k) for k in keys), *one.columns).select("*", rate)


def paired_by_seed(runs: DataFrame, a: str, b: str, metric: str, policy: str = "policy", on: tuple[str, ...] = ("seed",)) -> DataFrame:
    """The keys in ``on``, x, y: a metric of two policies, aligned on seed (and regime), never by position."""
    side = lambda p, name: runs.where(F.col(policy) == p).select(*on, F.col(metric).alias(name))
    return side(a, "x").join(side(b, "y"), list(on))


def first_member(df: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """The first row of each group in a given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


# --- datasets ---------------------------------------------------------------------------------------------------


def missing_sorted(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most first."""
    return missing(df).where("pct_missing > 0").orderBy(F.desc("pct_missing"), "column")


def named_like(df: DataFrame, column: str, prefix: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows whose text starts with a prefix and contains a text; both are literal."""
    if prefix is not None:
        df = df.where(F.col(column).startswith(prefix))
    return df if contains is None else df.where(F.col(column).contains(contains))


def frame_profile(frames: dict[str, DataFrame], sizes: dict[str, int] | None = None) -> DataFrame:
    """name, n_rows, n_columns, n_missing, pct_missing (of all cells), size_bytes of several frames; one job each."""
    parts = []
    for name, df in frames.items():
        empty = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0))
        row = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(empty), F.lit(0)).alias("n_missing"))
        cells = F.nullif(F.col("n_rows") * len(df.columns), F.lit(0))
        parts.append(
            row.select(
                F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_missing",
                F.coalesce(100.0 * F.col("n_missing") / cells, F.lit(0.0)).alias("pct_missing"),
                F.lit((sizes or {}).get(name)).cast("long").alias("size_bytes"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chart(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, total, most, mean, n: what a bar chart of a table draws, largest total first."""
    return df.groupBy(group).agg(F.sum(value).alias("total"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count("*").alias("n")).orderBy(F.desc("total"), group)


def file_totals(inventory: DataFrame, root: str) -> DataFrame:
    """dataset (first folder below the root), n_files, n_csv, n_zip, size_mb, size_gb of an inventory (path, ext, size_mb)."""
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    dataset = F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("")
    size = F.sum("size_mb")
    return inventory.groupBy(dataset.alias("dataset")).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("ext") == ".csv").alias("n_csv"), F.count_if(F.col("ext") == ".zip").alias("n_zip"),
        size.alias("size_mb"), (size / 1000.0).alias("size_gb"),
    )


def injection_effect(before: DataFrame, after: DataFrame, columns: list[str], label: str = "y", index: str = "tx_index") -> DataFrame:
    """One row: share of rows that an injection changed, and the prevalence before and after (which has to be equal)."""
    old = before.select(index, F.struct(*columns).alias("_old"), F.col(label).alias("_y"))
    both = after.select(index, F.struct(*columns).alias("_new"), label).join(old, index)
    return both.agg(
        F.avg((~F.col("_new").eqNullSafe(F.col("_old"))).cast("double")).alias("changed_share"),
        F.avg("_y").alias("prevalence_before"), F.avg(label).alias("prevalence_after"),
    )


def pilot_stream(spark, n: int = 1200, seed: int = 42) -> DataFrame:
    """tx_index, x1, x2, y, segment_key: a small generated stream whose label follows the sign of x1; halfway the rule
    turns over in segment W (even rows), while H stays as it is."""
    rng = np.random.default_rng(seed)
    x1 = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(0, 1, n - n // 2)])
    i = np.arange(n)
    turned = (i >= n // 2) & (i % 2 == 0)
    y = np.where(turned, x1 < 0, x1 > 0).astype(int)
    rows = pd.DataFrame({"tx_index": i, "x1": x1, "x2": rng.uniform(0, 10, n), "y": y, "segment_key": np.where(i % 2 == 0, "W", "H")})
    return spark.createDataFrame(rows, "tx_index long, x1 double, x2 double, y int, segment_key string")
