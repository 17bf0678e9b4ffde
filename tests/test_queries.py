"""Every registered query of the engine against its SQL, and the decompositions against the sequential fold."""

import pytest
from tests.oracle import compare, connect

from driftspark import queries as Q
from driftspark.streaming import fold

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, Q.queries()[name], Q.oracle_sql()[name], D) is None


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_has_rows(spark, name):
    df = Q.queries()[name](spark, D)
    n = {"inject": 1000, "preque": 850}.get(name[:6])  # a row a transaction, or a streamed one (warmup is 150 of 1,000)
    assert df.count() == n if n else df.where("tx_index between 0 and 999").count() == df.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(Q.oracle_sql()) <= set(entry.queries())


def _cfg(policy, **kw):
    return fold.RunConfig(policy, policy, warmup=150, window=200, interval=130, grace_period=20, delta=0.01, detector="hddm_a", **kw)


def _stream(spark):
    from pyspark.sql import functions as F

    # a label that turns over halfway, so that detectors have something to find
    df = Q.stream(spark, D).withColumn("turn", F.col("tx_index") >= 500)
    return df.withColumn("y", F.when(F.col("turn"), 1 - (F.col("k") % 2)).otherwise(F.col("k") % 2).cast("int")).withColumn("odd", F.col("k") % 2)


KEPT = ["tx_index", "y_true", "y_prob", "y_pred", "error", "segment_key", "adapted", "adaptation_scope"]


def _rows(df):
    return sorted(map(tuple, df.select(*KEPT).collect()), key=lambda r: r[0])


def test_periodic_epochs_equal_the_sequential_fold(spark):
    df, cfg = _stream(spark), _cfg("P1")
    one, many = _rows(fold.sequential(df, ["odd", "k"], cfg)), _rows(fold.epochs(df, ["odd", "k"], cfg))
    assert one == many and sum(r[6] for r in one) == (1000 - 150) // 130


def test_segments_equal_the_sequential_fold(spark):
    df, cfg = _stream(spark), _cfg("P3")
    one = fold.sequential(df, ["odd", "k"], cfg)
    assert _rows(one) == _rows(fold.by_segment(df, ["odd", "k"], cfg))
    assert one.where("adapted").count() > 0


def test_global_alarms_are_a_second_pass(spark):
    df, cfg = _stream(spark), _cfg("P3")
    inside = {r[0] for r in fold.sequential(df, ["odd"], cfg).where("drift_detected_global").select("tx_index").collect()}
    after = {r["tx_index"] for r in fold.alarms(fold.by_segment(df, ["odd"], cfg), "hddm_a").collect()}
    assert inside == after


def test_policies(spark):
    df = _stream(spark)
    frozen = fold.sequential(df, ["odd"], _cfg("P0", frozen=True))
    live = fold.sequential(df, ["odd"], _cfg("P0"))
    assert frozen.count() == live.count() == 850 and not frozen.where("adapted").count()
    assert _rows(frozen) != _rows(live)
    drifted = fold.sequential(df, ["odd"], _cfg("P2"))
    assert drifted.where("adapted").count() == drifted.where("drift_detected_global").count() > 0
    kept = fold.sequential(df, ["odd"], _cfg("P2", no_swap=True))
    assert not kept.where("adapted").count() and kept.where("adaptation_scope is not null").count()
    p1 = [r["tx_index"] for r in fold.sequential(df, ["odd"], _cfg("P1")).where("adapted").orderBy("tx_index").collect()]
    assert p1 == [150 + k * 130 - 1 for k in range(1, 7)]


def test_labels_do_not_leak(spark):
    from pyspark.sql import functions as F

    df, cfg = _stream(spark), _cfg("P0")
    flipped = df.withColumn("y", F.when(F.col("tx_index") == 700, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = (_rows(fold.sequential(x, ["odd", "k"], cfg)) for x in (df, flipped))
    assert [r[2] for r in a if r[0] <= 700] == [r[2] for r in b if r[0] <= 700]


def test_config_rules():
    with pytest.raises(ValueError):
        fold.RunConfig("x", "P9")
    with pytest.raises(ValueError):
        fold.RunConfig("x", "P1", interval=0)
    with pytest.raises(ValueError):
        fold.RunConfig("x", "P0", detector="other")
    assert fold.RunConfig("x", "segment_drift_triggered", detector="hddm").detector == "hddm_w"
    with pytest.raises(RuntimeError):
        fold.Retrainer(fold.RunConfig("x")).fit()


@pytest.mark.parametrize("policy", ["P1", "P3"])
def test_parallel_plans_equal_the_sequential_fold_in_all_columns(spark, policy):
    from pyspark.sql import functions as F

    df = _stream(spark).withColumn("segment_key", F.when(F.col("tx_index") % 7 > 0, F.col("segment_key")))
    # 800 = 150 + 5 * 130: the last row is an epoch's trigger, whose next epoch has no rows
    for rows in (df, df.where("tx_index < 800")):
        one, many = (sorted(f(rows, ["odd", "k"], _cfg(policy)).collect()) for f in (fold.sequential, fold.prequential))
        assert one == many
        assert any(r["drift_detected_global"] for r in one) and any(r["n_fraud_window"] for r in one)
    assert any(r["drift_detected_segment"] for r in many)
