"""Streaming runs that are stopped, killed and restarted, against the batch fold."""

import pytest
from pyspark.sql import functions as F

from driftspark.streaming import fold, keyed

SCHEMA = "tx_index long, x double, y int, segment_key string, note string"
COLUMNS = ["tx_index", "y_true", "y_prob", "error", "segment_key", "adapted", "adaptation_scope", "drift_detected_global", "drift_detected_segment", "n_window", "n_fraud_window"]


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    yield spark
    spark.conf.unset(keyed.PROVIDER) if before is None else spark.conf.set(keyed.PROVIDER, before)


def _data():
    segment = lambda i: (None, "a", "b", "")[i % 4]
    return [(i, float(i % 7), int((i % 7 > 3) != (i > 180)), segment(i), "n") for i in range(320)]


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _cfg(policy):
    return fold.RunConfig("r", policy, detector="hddm_a", warmup=60, window=100, interval=70, grace_period=20, delta=0.01)


@pytest.mark.parametrize("policy", ["P0", "P1", "P2", "P3"])
def test_a_killed_run_goes_on_without_loss_or_repeats(rocks, tmp_path, policy):
    spark, rows, cfg = rocks, _data(), _cfg(policy)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    _write(spark, rows[:150], source)

    def started(broken=False):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        if broken:  # dies in the middle of a batch
            stream = stream.withColumn("y", F.when(F.col("tx_index") == 260, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("y")))
        return keyed.to_table(keyed.stateful(stream, ["x"], cfg), out, cp)

    started().awaitTermination()
    _write(spark, rows[150:270], source)
    with pytest.raises(Exception, match="lost"):
        started(broken=True).awaitTermination()
    started().awaitTermination()
    _write(spark, rows[240:], source)  # some rows come twice
    started().awaitTermination()
    table = spark.createDataFrame(rows, SCHEMA)
    batch = fold.by_segment(table, ["x"], cfg) if policy == "P3" else fold.sequential(table, ["x"], cfg)
    got, want = (sorted(map(tuple, df.select(*COLUMNS).collect())) for df in (spark.read.parquet(out), batch))
    assert got == want and len(got) == 260
    assert policy == "P0" or any(r[5] for r in got)


def test_the_store_has_to_have_lists_and_maps(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    spark.conf.set(keyed.PROVIDER, "other")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            keyed.stateful(spark.createDataFrame([], SCHEMA), ["x"], _cfg("P0"))
    finally:
        spark.conf.unset(keyed.PROVIDER) if before is None else spark.conf.set(keyed.PROVIDER, before)


def test_replay_remembers_across_restarts(spark, tmp_path):
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    got, calls = [], []

    def sink(df, batch_id):
        calls.append(batch_id)
        ids = [r["tx_index"] for r in df.collect()]
        if len(calls) == 2:
            raise RuntimeError("killed")
        got.append((batch_id, ids))

    def run():
        stream = spark.readStream.schema("tx_index long").parquet(source)
        keyed.replay(stream, "tx_index", sink, cp).awaitTermination()

    spark.createDataFrame([(i,) for i in (2, 0, 1)], "tx_index long").coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(i,) for i in (5, 2, 1, 3)], "tx_index long").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="killed"):
        run()
    run()  # the failed batch is repeated with the same rows
    spark.createDataFrame([(i,) for i in (4, 5)], "tx_index long").coalesce(1).write.mode("append").parquet(source)
    run()  # nothing new: no call
    assert got == [(0, [0, 1, 2]), (1, [3, 5])] and calls == [0, 1, 1]


def test_a_large_batch_is_put_into_order_on_disk(monkeypatch):
    """Only a few batches are in memory; the first of equal indices comes first, with null segments and features."""
    import random
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    rng = random.Random(1)
    schema = pa.schema([("tx_index", pa.int64()), ("y", pa.int32()), ("segment_key", pa.string()), ("x", pa.float64())])
    for n, stretch in ((0, 10), (9, 10), (500, 10), (500, 64)):
        monkeypatch.setattr(keyed, "STRETCH", stretch)
        monkeypatch.setattr(keyed, "BATCH", 4)
        rows = [(rng.randrange(120) if i % 3 else 2**60 + i % 7, i, rng.choice([None, "a", ""]), float("nan") if i % 5 == 0 else i / 7) for i in range(n)]
        frames = [pd.DataFrame(rows[i : i + 7], columns=["tx_index", "y", "segment_key", "x"]).assign(run="r") for i in range(0, n, 7)]
        parts = list(keyed.in_index_order(iter(frames), schema))
        got = [r for p in parts for r in p.itertuples(index=False, name=None)]
        clean = lambda rows: [(i, y, None if s is None or s != s else s, None if x != x else x) for i, y, s, x in rows]
        assert [r[0] for r in got] == sorted(r[0] for r in rows) and sorted(r[1] for r in got) == list(range(n))
        first = lambda rows: list({r[0]: r for r in reversed(clean(rows))}.values())[::-1]
        assert first(got) == first(sorted(rows, key=lambda r: r[0]))
        assert n < stretch or len(parts) > 10
    monkeypatch.undo()

    def arriving(n):
        for i in range(0, n, 10_000):
            at = [(i + j) * 7919 % n for j in range(10_000)]
            yield pd.DataFrame({"tx_index": at, "y": 1, "segment_key": "a", "x": 0.5})

    peaks = []
    for n in (600_000, 1_800_000):
        tracemalloc.start()
        assert sum(map(len, keyed.in_index_order(arriving(n), schema))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_a_batch_beyond_a_stretch_equals_the_batch_fold(rocks, tmp_path, monkeypatch):
    spark, rows, cfg = rocks, _data(), _cfg("P1")
    _write(spark, [*rows[160:], *rows[:200]], str(tmp_path / "in"))  # out of order, some rows twice
    code = keyed.FoldProcessor.handleInputRows

    def small(self, *more):
        keyed.STRETCH, keyed.BATCH = 30, 8  # in the worker
        return code(self, *more)

    monkeypatch.setattr(keyed.FoldProcessor, "handleInputRows", small)
    keyed.to_table(keyed.stateful(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), ["x"], cfg), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = fold.sequential(spark.createDataFrame(rows, SCHEMA), ["x"], cfg)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).collect())) == sorted(map(tuple, want.select(*COLUMNS).collect()))


def test_a_deep_tree_is_kept():
    """A chain of 5,000 splits; its copy predicts and learns like it."""
    import pickle

    from driftspark.streaming.learners import HoeffdingTree, _Leaf, _Split

    tree = HoeffdingTree(20, 0.01)
    tree.fit_batch([({"x": float(i % 7)}, int(i % 7 > 3)) for i in range(400)])
    assert tree.n_splits
    for d in range(5000):
        tree.root = _Split("x", -1.0 - d, _Leaf((float(d), 1.0), d), tree.root, d)
    again = pickle.loads(pickle.dumps(tree))
    rows = [({"x": float(i % 90 - 80)}, i % 2) for i in range(100)]
    assert again.fit_batch(rows).model_complexity() == tree.fit_batch(rows).model_complexity()
    assert [again.predict_one(x) for x, _ in rows] == [tree.predict_one(x) for x, _ in rows]
    assert again.__dict__.keys() == tree.__dict__.keys()
