"""Distributed selection, prefix scans, as-of joins and equi-depth bins: equal to plain versions, and evenly dealt."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspark.functions import metrics, stats
from driftspark.functions.quantiles import quantiles
from driftspark.operators import events, prep
from driftspark.plans.layout import written
from driftspark.plans.scan import LAST, MAX, MIN, SUM, asof_join, running


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.exponential(1e-6, 900), rng.normal(0, 1e9, 200), np.full(700, 0.25), [0.0, -0.0, 1e150, -1e150, 5e-324]])
    rows = [(random.Random(i).choice(["a", "b", None]), float(v), float(i % 5) if i % 9 else None, float("nan"), 7) for i, v in enumerate(x)]
    df = written(spark.createDataFrame(rows, "g string, x double, y double, z double, value int"), "numbers")
    return df, df.toPandas()


@pytest.mark.parametrize("leaf", [10, 1 << 16])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles(numbers, leaf, by):
    df, pdf = numbers
    p = (0, 0.1, 0.5, 0.95, 0.999, 1)
    got = quantiles(df, ["x", "y", "z"], p, *by, leaf=leaf)
    assert "percentile" not in plan(got).lower() and "median" not in plan(got).lower()
    rows = got.collect()
    assert len(rows) == (6 if by else 2)  # z has no value
    for r in rows:
        own = pdf if not by else pdf[pdf["g"].isna()] if r["g"] is None else pdf[pdf["g"] == r["g"]]
        v = own[r["column"]].dropna().to_numpy()
        assert r["n"] == len(v) and np.allclose(r["q"], np.quantile(v, p), rtol=1e-12, atol=0)
        assert np.allclose([r["mean"], r["std"]], [v.mean(), v.std()])


def test_quantiles_of_infinite_and_single_values(spark):
    rows = [(float("inf"),), (float("-inf"),), *[(float(i),) for i in range(50)]]
    got = quantiles(spark.createDataFrame(rows, "x double"), ["x"], (0, 0.5, 1), leaf=3).first()["q"]
    assert got == [float("-inf"), 24.5, float("inf")]
    assert quantiles(spark.createDataFrame([(3.0,)], "x double"), ["x"], (0.3,)).first()["q"] == [3.0]
    assert quantiles(spark.createDataFrame([], "x double"), ["x"], (0.3,)).count() == 0


def test_fitted_medians_need_no_reducer(spark, numbers):
    df, pdf = numbers
    got = prep.fit_numeric(df, ["x", "y", "z"])
    assert "median(" not in plan(got)
    rows = {r["column"]: r for r in got.collect()}
    assert np.isclose(rows["x"]["median"], pdf["x"].median()) and rows["y"]["median"] == pdf["y"].median()
    assert tuple(rows["z"])[1:] == (0.0, 0.0, 1.0)


@pytest.mark.parametrize("chunk", [3, 7, 1 << 18])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_prefix_scan(spark, chunk, by):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(10) if rng.random() < 0.7 else None, 9) for i in range(150)]
    df = spark.createDataFrame(rows, "tx_index long, g string, v int, other int")
    folds = {"s": (SUM, F.col("v")), "most": (MAX, F.col("v")), "least": (MIN, F.col("v")), "last": (LAST, F.col("v"))}
    for inclusive in (True, False):
        out = running(df, folds, *by, inclusive=inclusive, chunk=chunk)
        assert "SinglePartition" not in plan(out)
        seen = {}
        for r in out.orderBy("tx_index").collect():
            own = seen.setdefault(r["g"] if by else 0, [])
            if inclusive and r["v"] is not None:
                own.append(r["v"])
            want = (sum(own), max(own), min(own), own[-1]) if own else (None,) * 4
            assert (r["s"], r["most"], r["least"], r["last"]) == want
            if not inclusive and r["v"] is not None:
                own.append(r["v"])


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_join(spark, direction, exact):
    rng = random.Random(5)
    rows = lambda n: [(rng.randrange(40) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), i) for i in range(n)]
    left, right = rows(60), rows(40)
    left += left[:5]
    a, b = spark.createDataFrame(left, "pos int, g string, i int"), spark.createDataFrame(right, "pos int, g string, i int")
    for within in (None, 3):
        out = asof_join(a, b, "pos", ["g"], direction, exact, ["i"], within, chunk=5)
        assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
        got = out.collect()
        assert sorted((r["i"], str(r["pos"])) for r in got) == sorted((i, str(p)) for p, _, i in left)
        for r in got:
            fits = [(p, i) for p, g, i in right if None not in (p, r["pos"]) and g == r["g"] and (p >= r["pos"] if direction == "forward" else p <= r["pos"]) and (exact or p != r["pos"])]
            best = min(fits, key=lambda t: (t[0] if direction == "forward" else -t[0], t[1]), default=None)
            if best and within is not None and abs(best[0] - r["pos"]) > within:
                best = None
            assert (r["found"] and (r["found"]["pos"], r["found"]["i"])) == best


def test_asof_join_of_nothing(spark):
    a = spark.createDataFrame([(1, "a")], "pos int, g string")
    assert asof_join(a, a.where("false"), "pos", ["g"]).first()["found"] is None
    assert asof_join(a.where("false"), a, "pos", ["g"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a, a, "pos", direction="near")


def test_many_onsets(spark):
    onsets = spark.createDataFrame([("a", 5), ("a", 9), ("b", 5), (None, 1)], "segment_key string, pos long")
    alarms = spark.createDataFrame([("a", 4), ("a", 9), ("b", 30), (None, 2)], "segment_key string, pos long")
    got = {(r["segment_key"], r["onset"]): (r["first_alarm"], r["delay"]) for r in events.detections(onsets, alarms).collect()}
    assert got == {("a", 5): (9, 4), ("a", 9): (9, 0), ("b", 5): (30, 25), (None, 1): (2, 1)}


def test_crowded_scores_are_dealt_evenly(spark):
    """99 % of the scores are below 0.001; no bin has more than twice the median number of distinct scores."""
    score = F.when(F.col("id") % 100 == 0, F.rand(1)).otherwise(F.rand(2) * 0.001)
    df = written(spark.range(40_000).select(score.alias("y_prob"), (F.rand(3) < F.lit(0.3)).cast("int").alias("y")), "crowded")
    cells = df.select(F.col("y_prob").alias("score"))
    sizes = sorted(r["count"] for r in cells.groupBy(metrics.bin_of(F.col("score"), metrics.borders(cells))).count().collect())
    assert len(sizes) > 200 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got, pdf = metrics.ranking(df).first(), df.toPandas()
    assert np.isclose(got["pr_auc"], events.plain_ap(pdf["y"].to_numpy(), pdf["y_prob"].to_numpy()))


def test_scores_outside_of_0_and_1_and_without_value(spark):
    rows = [(-3.0, 0), (-3.0, 1), (7.0, 1), (2.0, 0), (0.5, 1), (None, 1)]
    got = metrics.ranking(spark.createDataFrame(rows, "y_prob double, y int")).first()
    known = [r for r in rows if r[0] is not None]
    assert np.isclose(got["pr_auc"], events.plain_ap(np.array([y for _, y in known]), np.array([s for s, _ in known])))
    assert got["n_samples"] == 5
    assert metrics.ranking(spark.createDataFrame([], "y_prob double, y int")).first()["n_samples"] is None


def test_families_of_tests_of_any_size(spark):
    rng = np.random.default_rng(2)
    p = rng.random(300).round(3)
    df = written(spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "pos long, p double"), "tests")
    order = np.lexsort((np.arange(len(p)), p))
    holm, bh = np.empty(len(p)), np.empty(len(p))
    most, least = 0.0, 1.0
    for k, i in enumerate(order):
        most = max(most, 1 - (1 - p[i]) ** (len(p) - k))
        holm[i] = min(most, 1.0)
    for k, i in reversed(list(enumerate(order))):
        least = min(least, p[i] * len(p) / (k + 1))
        bh[i] = least
    for fn, want in ((stats.holm_sidak, holm), (stats.benjamini_hochberg, bh)):
        out = fn(df)
        assert "SinglePartition" not in plan(out)
        assert np.allclose([r["adjusted"] for r in out.orderBy("pos").collect()], want)
