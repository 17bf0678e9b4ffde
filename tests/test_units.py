"""Small exact cases of sources, preprocessing, injection, layout, statistics, learners and detectors."""

import random

import pytest
from pyspark.sql import functions as F

from driftspark.functions import metrics, stats
from driftspark.operators import inject, prep, profile
from driftspark.plans.layout import over_rows, prefixes, strided, with_index
from driftspark.sources import datasets
from driftspark.streaming import learners


def test_csv_sources(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "train_transaction.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD\n1,0,10,5.5,W\n2,1,20,NA,C\n")
    df = datasets.load_dataset(spark, "IEEE_CIS", str(tmp_path))
    assert dict(df.dtypes)["TransactionAmt"] == "double" and df.where("TransactionAmt is null").count() == 1
    (tmp_path / "train_identity.csv").write_text("TransactionID,DeviceType\n2,mobile\n")
    rows = {r["TransactionID"]: r["DeviceType"] for r in datasets.load_ieee_cis(spark, str(tmp_path)).collect()}
    assert rows == {1: None, 2: "mobile"}
    with pytest.raises(ValueError):
        datasets.load_ieee_cis(spark, str(tmp_path), "other")
    with pytest.raises(ValueError):
        datasets.get_dataset_metadata("none")
    with pytest.raises(FileNotFoundError):
        datasets.load_ulb(spark, str(tmp_path))
    (tmp_path / "creditcard.csv").write_text("Time,Amount\n1,2\n")
    with pytest.raises(ValueError, match="missing required column"):
        datasets.load_ulb(spark, str(tmp_path))
    assert datasets.inventory(spark, str(tmp_path)).where("ext = '.csv'").count() == 3
    assert "| 1 |" in datasets.save_markdown(df.select("TransactionID"), str(tmp_path / "t.md"))


def test_preprocessor(spark, tmp_path):
    rows = [(1, 10, None, "b", True, 0), (2, 20, 100.0, "a", False, 1), (3, 30, float("nan"), None, True, 0), (4, 40, 300.0, "z", None, 1)]
    df = spark.createDataFrame(rows, "id int, t int, x double, type string, flag boolean, y int")
    p = prep.Preprocessor("paysim", "y", "t", "id").fit(df.where("id < 4"))
    assert p.features == ["x", "type", "flag"] and p.numeric["x"] == (100.0, 100.0, 1.0) and p.vocabularies == {"type": {"a": 1, "b": 2}}
    out = [tuple(r) for r in p.transform(df, "id").orderBy("id").collect()]
    assert out == [(1, 100.0, 2, 1.0, 0, "b"), (2, 100.0, 1, 0.0, 1, "a"), (3, 100.0, 0, 1.0, 0, "nan"), (4, 300.0, 0, 1.0, 1, "z")]
    assert "segment_key" not in p.transform(df.drop("type"), "id").columns
    assert p.transform(df.drop("x", "type"), "id").first()[1:3] == (100.0, 0)
    p.save_state(str(tmp_path / "s" / "p.json"))
    again = prep.Preprocessor.load_state(str(tmp_path / "s" / "p.json"))
    assert [tuple(r) for r in again.transform(df, "id").orderBy("id").collect()] == out
    with pytest.raises(FileNotFoundError):
        prep.Preprocessor.load_state(str(tmp_path / "none.json"))
    old, prep.INLINE = prep.INLINE, 0
    try:
        assert [tuple(r) for r in p.transform(df, "id").orderBy("id").collect()] == out
        large = prep.Preprocessor("paysim", "y", "t", "id").fit(df.where("id < 4"))
        assert large.vocabularies == {"type": {}} and set(large.tables) == {"type"} and large.to_dict() == p.to_dict()
        assert [tuple(r) for r in large.transform(df, "id").orderBy("id").collect()] == out
        both = prep.Preprocessor("paysim", "y", "t", "id").fit_transform(df.where("id < 4"), "id")
        assert [tuple(r) for r in both.orderBy("id").collect()] == out[:3]
    finally:
        prep.INLINE = old
    with pytest.raises(ValueError):
        prep.warmup_rows(10, 1.0)


def test_injection(spark):
    df = spark.range(100).select(F.col("id").alias("tx_index"), F.lit(1.0).alias("C1"), F.lit(2.0).alias("C2"), F.when(F.col("id") % 2 == 0, "C").alias("segment_key"))
    cfg = inject.DriftConfig("localized", t_drift=20)
    hit = inject.inject(df, cfg, 50).where("C1 = 2.0").select("tx_index").orderBy("tx_index").collect()
    assert [r[0] for r in hit] == list(range(70, 100, 2))
    g = inject.inject(df, inject.DriftConfig("gradual", t_drift=5, transition_width=20), 50)
    p = {r["stream_idx"]: r["drift_prob"] for r in g.collect()}
    assert p[-1] == p[4] == 0.0 and p[25] == 1.0 and abs(p[15] - 0.5) < 1e-12 and abs(p[5] - 0.0066929) < 1e-6
    assert g.exceptAll(inject.inject(df, inject.DriftConfig("gradual", t_drift=5, transition_width=20), 50)).count() == 0
    with pytest.raises(ValueError):
        inject.DriftConfig("sudden", window_size=5)
    with pytest.raises(ValueError):
        inject.DriftConfig("other")
    with pytest.raises(ValueError):
        inject.inject(df, cfg, 101, n=100)


@pytest.mark.parametrize("regime", inject.REGIMES)
def test_events_and_streams_equal_the_frame(spark, regime):
    """The same rows, whole, as a stream with positions, and one by one outside of Spark; draws are NumPy's own."""
    df = spark.range(300).select(F.col("id").alias("tx_index"), F.col("id").cast("double").alias("C1"), (-F.col("id")).cast("double").alias("C2"), F.when(F.col("id") % 3 == 0, "C").alias("segment_key"))
    cfg = inject.DriftConfig(regime, t_drift=40, transition_width=100, recurrence_period=30)
    frame = inject.inject(df, cfg, 50)
    one = {r["stream_idx"]: (r["C1"], r["C2"], r["is_affected"]) for r in frame.where("stream_idx >= 0").collect()}
    moved = inject.inject_stream(df.where("tx_index >= 50").withColumn("stream_idx", F.col("tx_index") - 50), cfg)
    assert one == {r["stream_idx"]: (r["C1"], r["C2"], r["is_affected"]) for r in moved.collect()} and len(one) == 250
    for i, got in one.items():
        x, hit = inject.inject_event({"C1": i + 50.0, "C2": -i - 50.0}, "C" if (i + 50) % 3 == 0 else None, i, cfg)
        assert got == (x["C1"], x["C2"], hit)
    assert 0 < sum(hit for *_, hit in one.values()) < 250


def test_layout(spark):
    rnd = random.Random(1)
    values = [(rnd.randrange(50), i, rnd.random()) for i in range(500)]
    df = with_index(spark.createDataFrame(values, "a int, b int, v double").repartition(7), "a", "b")
    got = [(r["a"], r["b"]) for r in df.orderBy("tx_index").collect()]
    assert got == sorted((a, b) for a, b, _ in values) and df.agg(F.max("tx_index")).first()[0] == 499
    v = [x for _, _, x in sorted(values)]
    import driftspark.plans.layout as layout

    old, layout.CHUNK = layout.CHUNK, 40
    try:
        sums = over_rows(df, 9, 0, {"s": F.sum("v")}).orderBy("tx_index").collect()
    finally:
        layout.CHUNK = old
    assert all(abs(r["s"] - sum(v[max(0, i - 9) : i + 1])) < 1e-9 for i, r in enumerate(sums))
    got = {r["k"]: r["n"] for r in strided(df, 100, 30, 500).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {k: 100 for k in range(14)}
    got = {r["k"]: r["n"] for r in prefixes(df, 120, 500).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 120, 2: 240, 3: 360, 4: 480}
    assert strided(df, 600, 30, 500).count() == 0
    assert with_index(df.drop("tx_index").where("false"), "a").count() == 0


def test_null_rules_of_average_precision(spark):
    one = spark.createDataFrame([(0.5, 0), (0.4, 0)], "y_prob double, y int")
    assert metrics.ranking(one).first()["pr_auc"] is None and metrics.safe_ap(one).first()["ap"] is None
    assert metrics.slice_ap(one).first()["ap"] == 0.0 and metrics.trapezoid_ap(one).first()["pr_auc"] == 0.0
    mixed = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "y_prob double, y int")
    r = metrics.ranking(mixed).first()
    assert abs(r["pr_auc"] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12 and abs(r["roc_auc"] - 0.875) < 1e-12
    assert metrics.confusion(mixed.where("false")).first()["precision"] == 0.0


def test_tails():
    assert abs(stats.t_sf(2.228139, 10) - 0.025) < 1e-6 and abs(stats.t_ppf(0.975, 4) - 2.776445) < 1e-5
    assert abs(stats.f_sf(3.478050, 4, 10) - 0.05) < 1e-6
    assert stats.wilcoxon_p([1, 2, 3, 4, 5]) == 0.0625 and stats.wilcoxon_p([0, 0]) is None
    assert abs(stats.shapiro_p([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]) - 0.00670) < 2e-4
    out = stats.paired_comparison([3, 4, 5, 6], [1, 2, 3, 4], "a", "b")
    assert out["cohens_dz"] == 0.0 and out["t_statistic"] is None and out["mean_diff"] == 2 and not out["significant_at_alpha"]
    out = stats.paired_comparison([3.1, 4.4, 5.2, 6.9], [1, 2, 3, 4], "a", "b")
    assert out["significant_at_alpha"] and out["wilcoxon_statistic"] == 0.0 and out["n_seeds"] == 4 and out["se_diff"] > 0
    assert stats.signed_rank([1, -1, 2, 0, 3]) == 1.5
    with pytest.raises(ValueError):
        stats.paired_comparison([1], [2], "a", "b")


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (1, "x")], "a int, b string")
    assert tuple(profile.duplicates(df).first()) == (4, 1, 25.0)
    assert {r["column"]: (r["n_unique"], r["bucket"]) for r in profile.cardinality(df).collect()} == {"a": (2, "binary"), "b": (2, "binary")}
    assert {r["column"]: r["pct_missing"] for r in profile.missing(df).collect()} == {"a": 0.0, "b": 50.0}


@pytest.mark.parametrize("kind", ["adwin", "hddm_a", "hddm_w"])
def test_detectors(kind):
    d = learners.make_detector(kind)
    assert not any(d.update(0.0) for _ in range(500))
    assert any(d.update(1.0) for _ in range(500))
    quiet = learners.make_detector(kind)
    assert not any(quiet.update(0.0) for _ in range(2000))


def test_adwin_drops_its_older_part():
    d, rnd = learners.Adwin(), random.Random(1)
    for _ in range(1000):
        d.update(float(rnd.random() < 0.1))
    for _ in range(1000):
        d.update(float(rnd.random() < 0.6))
    assert d.n < 1400 and abs(d.total / d.n - 0.6) < 0.1
    assert sum(s for row in d.rows for s, _ in row) == d.total


def test_monitor_keeps_segments_apart():
    m = learners.DriftMonitor("hddm_a")
    for i in range(1000):
        m.update(float(i >= 500), i, "a")
        m.update(0.0, i, "b")
    keys = [k for k, _, _ in m.events]
    assert "a" in keys and "b" not in keys and m.updates == {"global": 2000, "a": 1000, "b": 1000}


def test_tree():
    rnd, tree = random.Random(2), learners.HoeffdingTree(grace_period=50, delta=1e-3)
    assert tree.predict_one({"x": 1.0}) == 0.0
    rows = [({"x": rnd.random(), "z": rnd.random()}, 0) for _ in range(3000)]
    rows = [(x, int(x["x"] > 0.5)) for x, _ in rows]
    tree.fit_batch(rows)
    assert sum(tree.predict_label(x) == y for x, y in rows[-500:]) > 470 and tree.model_complexity()["n_nodes"] >= 3
    tree.reset()
    assert tree.model_complexity() == {"n_nodes": 1.0, "n_leaves": 1.0, "height": 0.0}
