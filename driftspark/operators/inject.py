"""Controlled drift: column swaps whose activity is a function of the stream position, as column expressions.

Regimes are sudden, gradual (sigmoid probability, seeded draw), recurring (even cycles are swapped) and localized (one
segment only). ``stream_idx`` counts from the end of warmup; warmup rows are left alone and have negative ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Swapped column pairs; the regimes; the event names below.
SWAPS = (("C1", "C2"), ("C3", "C4"), ("card1", "card2"))
REGIMES = ("sudden", "gradual", "recurring", "localized")


@dataclass(frozen=True)
class DriftConfig:
    regime: str
    t_drift: int = 10_000
    transition_width: int = 5_000
    recurrence_period: int = 25_000
    target_segment: str = "C"
    seed: int = 42
    window_size: int = 10_000
    swap_pairs: tuple[tuple[str, str], ...] = SWAPS

    def __post_init__(self):
        if self.regime not in REGIMES:
            raise ValueError(f"regime has to be one of {REGIMES}")
        if self.window_size != 10_000:
            raise ValueError("window_size is fixed at 10000")
        if self.t_drift < 0 or self.transition_width <= 0 or self.recurrence_period <= 0:
            raise ValueError("t_drift must not be negative; widths and periods are positive")
        if not self.swap_pairs:
            raise ValueError("swap_pairs are needed")


@F.pandas_udf(T.DoubleType())
def _draws(seed: pd.Series, idx: pd.Series) -> pd.Series:
    """The first uniform number of a generator seeded per row."""
    import numpy as np

    return pd.Series([np.random.RandomState((s + i * 1009) % 2**32).rand() for s, i in zip(seed, idx, strict=True)])


def drift_probability(cfg: DriftConfig, idx: Column) -> Column:
    """Probability of the swapped concept by position alone; for a localized regime, within its segment."""
    t = F.lit(cfg.t_drift)
    if cfg.regime == "gradual":
        mid, slope = cfg.t_drift + cfg.transition_width / 2.0, 10.0 / cfg.transition_width
        x = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(slope) * (idx - mid)))
        inside = 1.0 / (1.0 + F.exp(-x))
        return F.when(idx < t, 0.0).when(idx >= t + cfg.transition_width, 1.0).otherwise(inside)
    if cfg.regime == "recurring":
        cycle = F.floor((idx - t) / cfg.recurrence_period)
        return F.when((idx >= t) & (F.pmod(cycle, F.lit(2)) == 0), 1.0).otherwise(0.0)
    return F.when(idx >= t, 1.0).otherwise(0.0)


def drift_state(df: DataFrame, cfg: DriftConfig, warmup: int, index: str = "tx_index", segment: str = "segment_key") -> DataFrame:
    """Adds stream_idx, regime, event_id, t_drift, is_affected, active_concept, transition_interval,
    recurrence_interval, target_segment and drift_prob."""
    # fixed values: the texts of event_id and active_concept
    idx, seg, t = F.col("stream_idx"), F.col(segment), F.lit(cfg.t_drift)
    warm = idx < 0
    p = drift_probability(cfg, idx)
    b = F.lit
    if cfg.regime == "sudden":
        hit, event = idx >= t, F.when(idx < t, "baseline_concept_a").otherwise("sudden_concept_b")
    elif cfg.regime == "gradual":
        late = idx >= t + cfg.transition_width
        # a Python function is not short-circuited, so only the rows of the transition go through it
        df = df.withColumn("stream_idx", (F.col(index) - warmup).cast("long"))
        inside = (idx >= t) & ~late
        draw = _draws(F.lit(cfg.seed).cast("long"), idx)
        drawn = df.where(inside).withColumn("_hit", draw < p)
        df = drawn.unionByName(df.where(~inside).withColumn("_hit", late))
        hit = F.col("_hit")
        event = F.when(idx < t, "gradual_pre_drift_a").when(late, "gradual_post_drift_b").otherwise("gradual_transition_window")
    elif cfg.regime == "recurring":
        hit, cycle = p == 1.0, F.floor((idx - t) / cfg.recurrence_period)
        name = F.concat(b("recurring_cycle_"), cycle.cast("string"), F.when(hit, "_b").otherwise("_a"))
        event = F.when(idx < t, "recurring_pre_drift_a").otherwise(name)
    else:
        mine = seg.eqNullSafe(F.lit(cfg.target_segment))
        hit, p = (idx >= t) & mine, F.when((idx >= t) & mine, 1.0).otherwise(0.0)
        event = (
            F.when(idx < t, "localized_pre_drift_a")
            .when(mine, f"localized_target_segment_{cfg.target_segment}_b")
            .otherwise(F.concat(b("localized_unaffected_segment_"), F.coalesce(seg.cast("string"), b("None")), b("_a")))
        )
    hit = F.when(warm, False).otherwise(hit)
    interval = F.struct(t.cast("long").alias("start"), (t + cfg.transition_width).cast("long").alias("end"))
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    out = df.withColumn("stream_idx", (F.col(index) - warmup).cast("long")).withColumns(
        {
            "regime": F.lit(cfg.regime),
            "event_id": F.when(warm, "warmup_baseline").otherwise(event),
            "t_drift": t.cast("long"),
            "is_affected": hit,
            "active_concept": F.when(hit, "concept_b").otherwise("concept_a"),
            "transition_interval": F.when(~warm, interval).otherwise(none) if cfg.regime == "gradual" else none,
            "recurrence_interval": F.lit(cfg.recurrence_period if cfg.regime == "recurring" else None).cast("long"),
            "target_segment": F.lit(cfg.target_segment if cfg.regime == "localized" else None).cast("string")
            if cfg.regime == "localized"
            else F.when(warm, cfg.target_segment),
            "drift_prob": F.when(warm, 0.0).otherwise(p),
        }
    )
    return out.drop("_hit")


def swap(df: DataFrame, pairs: tuple[tuple[str, str], ...] = SWAPS, when: str = "is_affected") -> DataFrame:
    """Exchanges the columns of each pair where a flag is set; pair by pair, so overlapping pairs compose. A pair with
    an absent column is skipped."""
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            x, y = F.col(a), F.col(b)
            df = df.withColumns({a: F.when(F.col(when), y).otherwise(x), b: F.when(F.col(when), x).otherwise(y)})
    return df


def inject(df: DataFrame, cfg: DriftConfig, warmup: int, index: str = "tx_index", segment: str = "segment_key", n: int | None = None) -> DataFrame:
    """Drift state and swapped columns of a whole stream; labels are untouched. A warmup beyond ``n`` rows, where that is
    given, is refused."""
    if n is not None and warmup > n:
        raise ValueError(f"a warmup of {warmup} rows exceeds the {n} rows there are")
    return swap(drift_state(df, cfg, warmup, index, segment), cfg.swap_pairs)


def inject_stream(stream: DataFrame, cfg: DriftConfig, index: str = "stream_idx", segment: str = "segment_key") -> DataFrame:
    """The same for a stream without warmup whose rows carry their position; batch or Structured Streaming, as all of it
    is a projection (the draw of a gradual drift, too)."""
    moved = stream.withColumn("_at", F.col(index))
    return inject(moved, cfg, 0, "_at", segment).drop("_at")


def inject_event(x: dict, segment: str | None, idx: int, cfg: DriftConfig) -> tuple[dict, bool]:
    """One event outside of Spark: its features, swapped where the concept at position ``idx`` is the new one, and
    whether that is so."""
    import numpy as np

    since, width = idx - cfg.t_drift, cfg.transition_width
    if since < 0:
        hit = False
    elif cfg.regime == "gradual":
        slope = 10.0 / width * (since - width / 2.0)
        chance = 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, slope))))
        hit = since >= width or np.random.RandomState((cfg.seed + idx * 1009) % 2**32).rand() < chance
    elif cfg.regime == "recurring":
        hit = since // cfg.recurrence_period % 2 == 0
    else:
        hit = cfg.regime == "sudden" or segment == cfg.target_segment
    out = dict(x)
    for a, b in cfg.swap_pairs if hit else ():
        if a in out and b in out:
            out[a], out[b] = out[b], out[a]
    return out, bool(hit)
