"""Sequential folds and detector passes in slices of the index: equal to one pass, and no task has more than a slice."""

import pytest
from pyspark.sql import functions as F

from driftspark.streaming import fold, grid
from driftspark.streaming.learners import make_detector

SCHEMA = "tx_index long, x double, y int, segment_key string"
SLICE = 64


@pytest.fixture
def small(monkeypatch):
    """Slices of 64 indices; the most rows of a group that any job puts into order, without states handed on."""
    most, whole = [], fold.in_order

    def counted(df, *key, **kw):
        most.append(df.where("tx_index is not null").groupBy(*key).count().agg(F.max("count")).first()[0] or 0)
        return whole(df, *key, **kw)

    monkeypatch.setattr(fold, "SLICE", SLICE, raising=False)
    for module in (fold, grid):
        monkeypatch.setattr(module, "in_order", counted)
    return most


def _data():
    """Segment c is only in the first and the last slice; segments may be null."""
    segment = lambda i: "c" if i < 5 or i >= 290 else (None, "a", "b", "")[i % 4]
    return [(i, float(i % 7), int((i % 7 > 3) != (i > 180)), segment(i)) for i in range(300)]


def _cfg(policy, **kw):
    return fold.RunConfig(kw.pop("run", "r"), policy, **({"detector": "hddm_a", "warmup": 90, "window": 100, "interval": 50, "grace_period": 20, "delta": 0.01} | kw))


def _one_pass(rows, cfg):
    return [r for r in fold.run_fold([(i, {"x": x}, y, s) for i, x, y, s in rows], cfg)]


CASES = [_cfg("P0", run="a"), _cfg("P2", run="b"), _cfg("P1", run="c", no_swap=True), _cfg("P3", run="d"), _cfg("P1", run="e"), _cfg("P2", run="f", detector="adwin", window=20)]


@pytest.mark.parametrize("cfg", CASES, ids=lambda c: c.run_id)
def test_a_run_in_slices_equals_one_pass(spark, small, cfg):
    df = spark.createDataFrame(_data(), SCHEMA).repartition(5)
    got = sorted(map(tuple, fold.prequential(df, ["x"], cfg).collect()), key=lambda r: r[1])
    want = _one_pass(_data(), cfg)
    assert got == want and len(got) == 210
    # an epoch's rows are its window's and interval's
    assert small and max(small) <= (SLICE if cfg.policy != "P1" or cfg.no_swap else cfg.window + cfg.interval)


def test_runs_of_a_grid_go_in_slices(spark, small):
    df = spark.createDataFrame(_data(), SCHEMA).repartition(5)
    got = {}
    for r in grid.run_grid(df, ["x"], CASES).collect():
        got.setdefault(r["run_id"], []).append(tuple(r))
    for cfg in CASES:
        assert sorted(got[cfg.run_id], key=lambda r: r[1]) == _one_pass(_data(), cfg)
    assert max(small) <= 150


@pytest.mark.parametrize("kind", ["adwin", "hddm_a", "hddm_w"])
def test_detectors_in_slices_equal_one_pass(spark, small, kind):
    rows = [(i, float((i // 100) % 2 and i % 3 > 0), (None, "a", "b")[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "tx_index long, error double, segment_key string").repartition(5)
    for by in (None, "segment_key"):
        detectors, want = {}, []
        for i, e, s in rows:
            key = "global" if by is None else s
            if detectors.setdefault(key, make_detector(kind)).update(e):
                want.append((key, i, kind))
        assert sorted(map(tuple, fold.alarms(df, kind, by).collect()), key=lambda r: r[1]) == want
    assert max(small) <= SLICE
    assert want or kind == "adwin"


def test_slices_of_nothing_and_of_rows_without_index(spark, small):
    df = spark.createDataFrame(_data(), SCHEMA)
    assert fold.sequential(df.where("false"), ["x"], _cfg("P0")).count() == 0
    with pytest.raises(ValueError, match="without tx_index"):
        fold.sequential(df.unionByName(df.limit(1).withColumn("tx_index", F.lit(None).cast("long"))), ["x"], _cfg("P0"))
