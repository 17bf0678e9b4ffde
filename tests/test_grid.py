"""Many runs as one plan, runs as tables, learners and detectors in SQL, and sources inside archives."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from driftspark import queries as Q
from driftspark.plans.runs import RunTables
from driftspark.sources import datasets
from driftspark.streaming import fold, table_functions
from driftspark.streaming.grid import run_grid
from driftspark.streaming.learners import HoeffdingTree

D = "/root/testdata/sf0.001"


def _stream(spark):
    df = Q.stream(spark, D).withColumn("turn", F.col("tx_index") >= 500).withColumn("odd", F.col("k") % 2)
    df = df.withColumn("segment_key", F.when(F.col("tx_index") % 7 > 0, F.col("segment_key")))
    return df.withColumn("y", F.when(F.col("turn"), 1 - F.col("odd")).otherwise(F.col("odd")).cast("int"))


def _cfg(run, policy, **kw):
    return fold.RunConfig(run, policy, **({"warmup": 150, "window": 200, "interval": 130, "grace_period": 20, "delta": 0.01, "detector": "hddm_a"} | kw))


def test_runs_of_one_plan_equal_those_run_alone(spark):
    df = _stream(spark)
    cfgs = [
        _cfg("a", "P0"), _cfg("b", "P0", frozen=True), _cfg("c", "P1"), _cfg("d", "P1", interval=90, window=300, warmup=100), _cfg("e", "P2", detector="adwin"),
        _cfg("f", "P3"), _cfg("g", "P1", no_swap=True), _cfg("h", "P3", window=50, detector="hddm_w"),
    ]
    got = {}
    for r in run_grid(df, ["odd", "k"], cfgs).collect():
        got.setdefault(r["run_id"], []).append(tuple(r))
    for cfg in cfgs:
        alone = sorted(map(tuple, fold.prequential(df, ["odd", "k"], cfg).collect()), key=lambda r: r[1])
        assert sorted(got[cfg.run_id], key=lambda r: r[1]) == alone
    assert any(r[7] for r in got["f"]) and any(r[9] for r in got["c"])
    with pytest.raises(ValueError):
        run_grid(df, ["k"], [_cfg("a", "P0"), _cfg("a", "P1")])


def test_runs_read_their_own_variant(spark):
    df = _stream(spark)
    both = df.withColumn("regime", F.lit("as_is")).unionByName(df.withColumn("y", 1 - F.col("y")).withColumn("regime", F.lit("turned")))
    cfgs = [_cfg("a", "P1"), _cfg("b", "P1"), _cfg("c", "P3")]
    got = run_grid(both, ["odd"], cfgs, {"a": "as_is", "b": "turned", "c": "turned"}, "regime").collect()
    for cfg, rows in zip(cfgs, (df, *[df.withColumn("y", 1 - F.col("y"))] * 2), strict=True):
        alone = sorted(map(tuple, fold.prequential(rows, ["odd"], cfg).collect()))
        assert sorted(tuple(r) for r in got if r["run_id"] == cfg.run_id) == alone


class Counting(HoeffdingTree):
    made = 0

    def __init__(self):
        Counting.made += 1
        super().__init__(20, 0.01)


def test_a_learner_is_made_once():
    Counting.made = 0
    rows = [(i, {"x": float(i % 3)}, i % 2, "a") for i in range(100)]
    assert len(fold.run_fold(rows, fold.RunConfig("r", "P0", warmup=10, learner_factory=Counting))) == 90 and Counting.made == 1


def test_rows_out_of_order_are_an_error(spark):
    import pandas as pd
    import pyarrow as pa

    batch = lambda *i: pa.RecordBatch.from_pandas(pd.DataFrame({"tx_index": i}))
    assert [len(p) for p in fold._ordered(iter([batch(1, 2), batch(2, 3)]))] == [2, 2]
    for bad in ([batch(2, 1)], [batch(1, 5), batch(3)]):
        with pytest.raises(RuntimeError):
            list(fold._ordered(iter(bad)))


def test_run_tables(spark, tmp_path):
    store = RunTables(spark, str(tmp_path / "runs"))
    jobs = spark.createDataFrame([("007",), ("b",), ("c",)], "job_id string")
    assert store.remaining(jobs).count() == 3
    rows = lambda x, *ids: spark.createDataFrame([(i, n, x) for i in ids for n in range(3)], "job_id string, n int, x double")
    store.write("records", rows(1.0, "007", "b"))
    store.commit(spark.createDataFrame([("007", 0.5)], "job_id string, pr_auc double"))
    # b died before its commit: it is not read, and runs again
    assert {r["job_id"] for r in store.read("records").collect()} == {"007"}
    assert {r["job_id"] for r in store.remaining(jobs).collect()} == {"b", "c"}
    store.write("records", rows(2.0, "b", "c"))
    store.commit(spark.createDataFrame([("b", 0.25), ("c", 0.75)], "job_id string, pr_auc double"))
    again = RunTables(spark, str(tmp_path / "runs"))
    assert sorted((r["job_id"], r["n"], r["x"]) for r in again.read("records").collect()) == [("007", n, 1.0) for n in range(3)] + [(j, n, 2.0) for j in "bc" for n in range(3)]
    assert again.remaining(jobs).count() == 0 and {r["job_id"]: r["pr_auc"] for r in again.done().collect()} == {"007": 0.5, "b": 0.25, "c": 0.75}
    one = again.read("records", ["c"])
    assert one.count() == 3 and "PartitionFilters: [job_id" in one._jdf.queryExecution().executedPlan().toString().replace("isnotnull(job_id", "job_id")
    with pytest.raises(ValueError):
        store.write("commits", rows(1.0, "a"))
    with pytest.raises(ValueError):
        store.write("records", spark.range(1))


def test_detectors_in_sql(spark):
    table_functions.register(spark)
    error = F.when(F.col("tx_index") % 400 >= 200, 1).otherwise((F.col("k") % 3 == 0).cast("int"))
    df = _stream(spark).withColumn("error", error)
    df.createOrReplaceTempView("records")
    found = 0
    for kind in ("adwin", "hddm_a", "hddm_w"):
        call = f"SELECT * FROM detect(TABLE(SELECT tx_index, segment_key, error FROM records WHERE segment_key IS NOT NULL) PARTITION BY segment_key ORDER BY (tx_index), 'error', '{kind}')"
        got = sorted(r["tx_index"] for r in spark.sql(call).collect())
        want = sorted(r["tx_index"] for r in fold.alarms(df.where("segment_key is not null"), kind, "segment_key").collect())
        assert got == want
        found += len(got)
    assert found
    for bad in ("'none_such', 'adwin'", "'error', 'other'", "segment_key, 'adwin'"):
        with pytest.raises(Exception, match="no column|unknown detector|constant|UNRESOLVED|cannot be resolved"):
            spark.sql(f"SELECT * FROM detect(TABLE(SELECT tx_index, segment_key, error FROM records) PARTITION BY segment_key ORDER BY (tx_index), {bad})").collect()


@pytest.mark.parametrize("policy", ["P0", "P1", "P2", "P3"])
def test_learners_in_sql(spark, policy):
    table_functions.register(spark)
    df = _stream(spark)
    df.withColumn("run", F.lit("r")).withColumn("k", F.col("k").cast("double")).createOrReplaceTempView("runs")
    got = spark.sql(f"SELECT * FROM prequential(TABLE(SELECT run, tx_index, y, segment_key, odd, k FROM runs) PARTITION BY run ORDER BY (tx_index), '{policy}', 'hddm_a', 150, 200, 'odd, k')")
    cfg = fold.RunConfig("", policy, "hddm_a", 150, 200, interval=200)
    want = fold.sequential(df, ["odd", "k"], cfg).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def _zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives_are_read_in_tasks(spark, tmp_path):
    _zip(tmp_path / "a.zip", {"deep/creditcard.csv": "﻿Time,Amount,Class\r\n1,2.5,0\r\n2,,1\r\n", "readme.txt": "no", "deep/": ""})
    _zip(tmp_path / "b.zip", {"more.csv": 'Time,Amount,Class\n3,"4,5",1\n\n'})
    lines = datasets.zip_lines(spark, str(tmp_path / "*.zip"))
    assert sorted((r["member"], r["line_no"]) for r in lines.collect()) == [("deep/creditcard.csv", i) for i in range(3)] + [("more.csv", i) for i in range(3)]
    table = datasets.scan_zip(spark, str(tmp_path / "*.zip"))
    assert dict(table.dtypes) == {"Time": "bigint", "Amount": "string", "Class": "bigint"}
    assert sorted((r["Time"], r["Amount"]) for r in table.collect()) == [(1, "2.5"), (2, None), (3, "4,5")]
    # by a path that only Spark reads
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.zips.link./in", f"file://{tmp_path}")
    far = datasets.scan_zip(spark, "viewfs://zips/in/a.zip")
    assert dict(far.dtypes) == {"Time": "bigint", "Amount": "double", "Class": "bigint"} and far.count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "creditcard.csv").write_text("Time,Amount,Class\n1,2.5,0\n")
    assert datasets.load_dataset(spark, "ulb", "viewfs://zips/in").count() == 1
    _zip(tmp_path / "c.zip", {"other.csv": "a,b\n1,2\n"})
    with pytest.raises(ValueError):
        datasets.scan_zip(spark, str(tmp_path / "*.zip"))
    with pytest.raises(FileNotFoundError):
        datasets.scan_zip(spark, str(tmp_path / "a.zip"), "*.tsv")


def test_long_members_come_in_stretches():
    text = io.StringIO("".join(f"{i}\n" for i in range(1000)))
    batches = list(datasets._stretches("a", "m", text, 500))
    assert len(batches) > 5 and [x for b in batches for x in b["line_no"].to_pylist()] == list(range(1000))
    assert [x for b in batches for x in b["line"].to_pylist()] == [str(i) for i in range(1000)]
