"""Many runs as one distributed plan: configurations are rows, and every run is split as far as its policy allows.

A row of the stream goes to each run that reads it, and there to the part that needs it: the run itself (P0, P2), the
row's segment (P3), or the epoch that it belongs to and those that train on it (P1). One shuffle by (run, part) schedules
all parts of all runs together, largest run or not. Parts that grow with the stream (runs, segments, first epochs) go in
slices of the index, all runs' parts in one job a slice. Alarms that never feed back are one more pass, also in slices,
over all runs' errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.plans.layout import written
from driftspark.streaming.fold import _ARROW, _COLUMNS, RECORDS, Fold, RunConfig, _batch, _epoch, _hits, _needed, _ordered, _recorded, in_order, in_slices
from driftspark.streaming.learners import make_detector


def _kind(cfg: RunConfig) -> str:
    if cfg.policy == "P3" and not cfg.timed:
        return "segment"
    return "epoch" if cfg.policy == "P1" and not (cfg.no_swap or cfg.retrain or cfg.timed) else "run"


def _assigned(stream: DataFrame, cfgs: Sequence[RunConfig], variants: dict[str, str], variant: str | None) -> DataFrame:
    """Rows with run (a struct) for each run that reads them."""
    spec = [
        F.struct(
            F.lit(c.run_id).alias("run_id"), F.lit(_kind(c)).alias("kind"), F.lit(c.warmup).cast("long").alias("warmup"),
            F.lit(c.window).cast("long").alias("window"), F.lit(c.interval).cast("long").alias("interval"), F.lit(variants.get(c.run_id)).cast("string").alias("variant"),
        )
        for c in cfgs
    ]
    runs = F.array(*spec)
    if variant is not None:
        runs = F.filter(runs, lambda r: r["variant"].eqNullSafe(F.col(variant)))
    return stream.withColumn("run", F.explode(runs))


def _parts(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows with the first and last epoch that trains on them (P1), these as columns, low above high where there is none."""
    run = F.col("run")
    after = F.col("tx_index") - run["warmup"]
    low = F.greatest(F.floor(after / run["interval"]) + 1, F.lit(1)).cast("long")
    high = F.floor((after + run["window"]) / run["interval"]).cast("long")
    return rows, low, high


def run_grid(stream: DataFrame, features: list[str], cfgs: Sequence[RunConfig], variants: dict[str, str] | None = None, variant: str | None = None) -> DataFrame:
    """RECORDS of all runs, each equal to ``fold.prequential`` of its own.

    With ``variant`` a column of the stream (a drift regime, say), a run reads the rows whose value is ``variants`` of its
    run_id. The configurations are on the driver and in the tasks; rows are a shuffle of each run's own rows."""
    by_id = {c.run_id: c for c in cfgs}
    if len(by_id) < len(cfgs):
        raise ValueError("two runs have the same run_id")
    needed = _needed(stream, features) if variant is None else stream.select("tx_index", "y", "segment_key", variant, *(F.col(f).cast("double").alias(f) for f in features))
    rows, low, high = _parts(_assigned(needed.where(F.col("tx_index").isNotNull()), cfgs, variants or {}, variant))
    run, after = F.col("run"), F.col("tx_index") - F.col("run")["warmup"]
    top = needed.agg(F.max("tx_index")).first()[0] or 0
    last = F.greatest(F.floor((F.lit(top) - run["warmup"]) / run["interval"]), F.lit(0)).cast("long")
    epoch = F.greatest(F.floor(after / run["interval"]), F.lit(0)).cast("string")
    part = F.when(run["kind"] == "epoch", epoch).when(run["kind"] == "segment", F.concat(F.lit("="), F.col("segment_key"))).otherwise(F.lit(""))
    own = F.struct(part.alias("part"), ((run["kind"] == "epoch") & (F.col("tx_index") < run["warmup"])).alias("train"))
    training = F.when((run["kind"] == "epoch") & (low <= F.least(high, last)), F.transform(F.sequence(low, F.least(high, last)), lambda k: F.struct(k.cast("string").alias("part"), F.lit(True).alias("train"))))
    spread = rows.withColumn("at", F.explode(F.concat(F.array(own), F.coalesce(training, F.array().cast("array<struct<part:string,train:boolean>>")))))
    spread = spread.select(run["run_id"].alias("run_id"), "at.part", "at.train", "tx_index", "y", "segment_key", *features)

    def begin(key: tuple, kept):
        """A run's configuration, and its fold, or the model of an epoch."""
        cfg = by_id[key[0]]
        if _kind(cfg) == "epoch":
            return cfg, cfg.learner() if kept is None else kept
        return cfg, Fold(cfg, kept)

    def step(state: tuple, pdf: pd.DataFrame) -> pa.RecordBatch:
        cfg, at = state
        if _kind(cfg) == "epoch":
            return _batch(_epoch(at, pdf, features, cfg))
        frame = _recorded(at, pdf, features)
        if _kind(cfg) == "segment":
            frame["drift_detected_global"] = None
        return _batch(frame)

    def kept(state: tuple):
        cfg, at = state
        return at if _kind(cfg) == "epoch" else at.kept()

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begin(tuple(k.as_py() for k in key), None)
        for pdf in _ordered(batches):
            yield step(state, pdf)

    # an epoch but the first, which learns all warmup rows, is bounded by window and interval; all else goes in slices
    bounded = F.col("run_id").isin([c.run_id for c in cfgs if _kind(c) == "epoch"]) & (F.col("part") != "0")
    others = in_order(spread.where(bounded), "run_id", "part").applyInArrow(fold, RECORDS)
    records = written(others.unionByName(in_slices(spread.where(F.coalesce(~bounded, F.lit(True))), ["run_id", "part"], begin, step, kept, _ARROW, RECORDS)), "grid")
    periodic = rows.where(run["kind"] == "epoch")
    sizes = periodic.where(low <= high).withColumn("epoch", F.explode(F.sequence(low, high)))
    trigger = (run["warmup"] + F.col("epoch") * run["interval"] - 1).alias("tx_index")
    sizes = sizes.groupBy(run["run_id"].alias("run_id"), trigger).agg(F.count("*").cast("int").alias("_n"), F.sum("y").cast("int").alias("_frauds"))
    out = records.join(sizes, ["run_id", "tx_index"], "left")
    for name, key in (("drift_detected_global", F.lit("")), ("drift_detected_segment", F.col("segment_key"))):
        rows_of = records.where(F.col(name).isNull()).withColumn("of", key).where("of is not null")
        hits = _hits(rows_of, ["run_id", "of"], lambda group: make_detector(by_id[group[0]].detector, **by_id[group[0]].detector_kwargs))
        hits = hits.select("run_id", "tx_index", F.lit(True).alias("_hit"))
        out = out.join(hits, ["run_id", "tx_index"], "left").withColumn(name, F.coalesce(name, "_hit", F.lit(False))).drop("_hit")
    return out.withColumns({"n_window": F.coalesce("n_window", "_n"), "n_fraud_window": F.coalesce("n_fraud_window", "_frauds")}).select(*_COLUMNS)

