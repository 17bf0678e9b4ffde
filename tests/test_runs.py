"""Jobs, artifacts, configuration, reports, hooks of the fold, sources that no query reads, and the streaming variants."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from driftspark import queries as Q
from driftspark.operators import events, profile, reports
from driftspark.plans import jobs
from driftspark.sources import datasets
from driftspark.streaming import fold

D = "/root/testdata/sf0.001"


def _artifact(**more):
    run = {"experiment": "m", "dataset": "d", "policy": "P1", "seed": 42, "window_size": None, "no_swap": False, "n_warmup": 10, "n_stream": 90}
    return jobs.run_artifact("d_m_P1_seed42", run, {"pr_auc": 0.5, "roc_auc": 0.7}, {"p50": 0.001, "p95_ms": 3.0}, [{"tx_index": 1}], [], 4.5, **more)


def test_names_and_atomic_files(tmp_path):
    assert jobs.job_id("d", "m", "P1", 42) == jobs.job_id("d", "m", "P1", 42, 5000) == "d_m_P1_seed42"
    assert jobs.job_id("d", "m", "P1", 42, 10_000, True) == "d_m_P1_W10000_noswap_seed42"
    assert jobs.artifact_name("P3", 7, 20_000) == "run_P3_W20000_seed7.json" and jobs.event_job_id("P2", "sudden", 10_000, 1) == "e3_P2_sudden_W10000_seed1"
    path = tmp_path / "deep" / "x.json"
    jobs.atomic_write_json({"a": 1}, str(path))
    assert json.loads(path.read_text()) == {"a": 1}
    with pytest.raises(TypeError):
        jobs.atomic_write_json({"a": object()}, str(path))
    assert json.loads(path.read_text()) == {"a": 1} and [p.name for p in path.parent.iterdir()] == ["x.json"]
    assert jobs.now().endswith("+00:00")
    for bad in (True, -1, 1.0):
        with pytest.raises(ValueError):
            jobs.set_seed(bad)
    jobs.set_seed(5)
    first = random.random()
    jobs.set_seed(5)
    assert random.random() == first


def test_artifacts():
    a = _artifact(regime="sudden")
    assert a["throughput_tx_per_sec"] == 20.0 and a["adaptation_count"] == 1 and a["drift_event_count"] == 0 and a["regime"] == "sudden"
    assert (a["latency_percentiles"]["p50_ms"], a["latency_percentiles"]["p95_ms"], a["latency_percentiles"]["p99_ms"]) == (1.0, 3.0, 0.0)


def test_manifest_and_resume(spark, tmp_path):
    m = jobs.Manifest(str(tmp_path))
    name = jobs.artifact_name("P1", 42)
    assert m.start("d_m_P1_seed42", name) and m.jobs["d_m_P1_seed42"]["status"] == jobs.RUNNING
    m.complete("d_m_P1_seed42", _artifact())
    assert m.start("bad", "bad.json")
    with pytest.raises(RuntimeError):
        m.complete("bad", {"policy": "P1"})
    m.fail("bad", "no metrics")
    again = jobs.Manifest(str(tmp_path))
    assert not again.start("d_m_P1_seed42", name) and again.jobs["bad"]["status"] == jobs.FAILED
    saved = json.loads((tmp_path / "manifest.json").read_text())
    assert (saved["total_jobs"], saved["completed_jobs"]) == (2, 1)
    assert set(zipfile.ZipFile(tmp_path / "artifacts.zip").namelist()) == {"manifest.json", f"runs/{name}"}
    row = again.table(spark).where("status = 'COMPLETED'").first()
    assert (row["pr_auc"], row["latency_p50_ms"], row["adaptation_count"], row["throughput_tx_per_sec"]) == (0.5, 1.0, 1, 20.0)
    assert [r["job_id"] for r in jobs.remaining(again.table(spark), again.table(spark).where("status = 'COMPLETED'")).collect()] == ["bad"]
    # an artifact on disk that no job knows, and one under the older name of the default window
    old = jobs.legacy_names("P2", 1, None)[1]
    jobs.atomic_write_json(_artifact() | {"job_id": "other", "policy": "P2"}, str(tmp_path / old))
    assert old == "run_P2_W5000_seed1.json" and jobs.legacy_names("P0", 1, None) == ["run_P0_seed1.json"]
    rows = {r["job_id"]: (r["status"], r["complete"]) for r in again.with_artifacts(spark).collect()}
    assert rows == {"d_m_P1_seed42": ("COMPLETED", True), "bad": ("FAILED", False), "other": ("COMPLETED", True)}
    assert not again.start("p2", *jobs.legacy_names("P2", 1, None)) and again.jobs["p2"]["artifact"] == old
    events_only = jobs.Manifest(str(tmp_path / "e3"), jobs.EVENT_KEYS)
    assert events_only.start("x", "x.json")
    with pytest.raises(RuntimeError):
        events_only.complete("x", _artifact())
    events_only.complete("x", _artifact(regime="sudden", event_centered_metrics={}))
    (tmp_path / "e3" / "manifest.json").write_text("{broken")
    assert jobs.Manifest(str(tmp_path / "e3")).jobs == {}


GOOD = {
    "experiment_id": "x", "seed": 1, "dataset": {"name": "ulb", "path": "p", "warmup_fraction": 0.2}, "learner": {"type": "hoeffding_tree", "params": {}},
    "detector": {"type": "adwin"}, "policy": {"type": "segment_drift_triggered", "segment_feature": "s", "adaptation_window_size": 10}, "output": {"artifact_dir": "o"},
}


@pytest.mark.parametrize(
    "section,key,value",
    [(None, "seed", True), (None, "seed", -1), (None, "output", None), (None, "dataset", 3), ("dataset", "warmup_fraction", 1.0), ("dataset", "warmup_fraction", True), ("dataset", "path", None),
     ("learner", "type", "other"), ("learner", "params", 3), ("detector", "type", "other"), ("policy", "type", "other"), ("policy", "type", "periodic"), ("policy", "segment_feature", 5),
     ("policy", "adaptation_window_size", 0), ("output", "artifact_dir", "")],
)
def test_configuration_rules(section, key, value):
    bad = json.loads(json.dumps(GOOD))
    part = bad if section is None else bad[section]
    if value is None:
        del part[key]
    else:
        part[key] = value
    with pytest.raises(ValueError):
        jobs.ExperimentConfig(bad).validate()


def test_configuration_files(tmp_path):
    jobs.ExperimentConfig(GOOD).save_yaml(str(tmp_path / "c.yaml"))
    assert jobs.ExperimentConfig.from_yaml(str(tmp_path / "c.yaml")).data == GOOD
    with pytest.raises(ValueError):
        jobs.ExperimentConfig([]).validate()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    head = ",".join(datasets.DATASETS["paysim"].required)
    (tmp_path / "a" / "small.csv").write_text(head + "\n")
    (tmp_path / "a" / "large.csv").write_text(head + "\n" + "1,x,2.5,c,0,0,m,0,0,1\n" * 3)
    assert datasets.load_dataset(spark, "paysim", str(tmp_path)).count() == 3
    assert {k: v.count() for k, v in datasets.load_all(spark, str(tmp_path), ("small.csv",)).items()} == {"large": 3}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("creditcard.csv", "Time,Amount,Class\n1,2.5,0\n2,,1\n")
    assert datasets.unzip(str(tmp_path / "z.zip"), str(tmp_path / "out")) == ["creditcard.csv"]
    ulb = datasets.load_dataset(spark, "ulb", str(tmp_path))
    assert ulb.where("Amount is null").count() == 1
    assert datasets.resolve_dir("creditcard.csv", str(tmp_path / "none"), str(tmp_path)) == str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        datasets.resolve_dir("other.csv", str(tmp_path))
    datasets.save_csv(ulb, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    tex = datasets.save_latex(spark.createDataFrame([("a_b", 5)], "name string, pct int"), str(tmp_path / "t" / "t.tex"))
    assert r"a\_b & 5 \\" in tex and (tmp_path / "t" / "t.tex").read_text().startswith(r"\begin{tabular}{ll}")
    totals = {r["dataset"]: (r["n_files"], r["n_csv"], r["n_zip"]) for r in reports.file_totals(datasets.inventory(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert totals[""] == (1, 0, 1) and totals["a"] == (2, 2, 0)


def test_reports(spark):
    log = spark.createDataFrame([("global", 9), ("b", 3), ("a", 5), ("b", 4)], "stream_key string, tx_index int")
    assert {r["stream_key"]: r["n"] for r in reports.drift_counts(log).collect()} == {"global": 1, "a": 1, "b": 2}
    assert tuple(reports.drift_state(log).first()) == (True, True, ["b", "a"])
    assert tuple(reports.drift_state(log.where("false")).first()) == (False, False, [])
    none = reports.horizon_means(spark.createDataFrame([], "pre_ap double, post_ap double, delta double")).first()
    assert none["n_events"] == 0 and none["drop_share"] is None
    late = spark.createDataFrame([(5, 1.5), (8, 2.0)], "pos int, duration_s double")
    assert tuple(events.adaptations_after(late, 6).first()) == (1, 2.0) and tuple(events.adaptations_after(late, 9).first()) == (0, 0.0)
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    assert [tuple(r) for r in reports.missing_sorted(df).select("column", "n_missing").collect()] == [("b", 2)]
    assert profile.missing(df.where("false")).first()["pct_missing"] == 0.0
    pilot = reports.pilot_stream(spark, 400)
    assert pilot.where("segment_key = 'H' and y != (x1 > 0)::int").count() == 0
    assert pilot.where("segment_key = 'W' and y != ((x1 > 0) = (tx_index < 200))::int").count() == 0 and pilot.count() == 400


def test_plain_average_precision(spark):
    import numpy as np

    rnd = random.Random(4)
    for _ in range(20):
        rows = [(rnd.randrange(5) / 5, rnd.randrange(2)) for _ in range(rnd.randrange(1, 30))]
        want = Q.metrics.safe_ap(spark.createDataFrame(rows, "y_prob double, y int")).first()["ap"]
        got = events.plain_ap(np.array([y for _, y in rows]), np.array([p for p, _ in rows]))
        assert (got is None) == (want is None) and (want is None or abs(got - want) < 1e-12)


class Majority:
    """A learner of three methods: the share of positives so far."""

    def __init__(self):
        self.n = self.k = 0

    def predict_one(self, x):
        return self.k / self.n if self.n else 0.0

    def learn_one(self, x, y):
        self.n, self.k = self.n + 1, self.k + y

    def fit_batch(self, rows):
        for x, y in rows:
            self.learn_one(x, y)


def _rows(n=300):
    return [(i, {"x": float(i % 7)}, int(i % 5 == 0), "ab"[i % 2]) for i in range(n)]


def test_learners_and_retrains_can_be_replaced():
    cfg = fold.RunConfig("r", "P1", warmup=50, window=40, interval=60, learner_factory=Majority, timed=True)
    out = fold.run_fold(_rows(), cfg)
    assert out[0][3] == 10 / 50 and [r[1] for r in out if r[7]] == [109, 169, 229, 289]
    after = next(r for r in out if r[1] == 110)
    assert after[3] == sum(i % 5 == 0 for i in range(70, 110)) / 40 and all((r[13] is not None) == r[7] for r in out)
    asked = []

    def retrain(buffer, segment_key=None):
        asked.append((len(buffer.window(segment_key)), segment_key))
        return Majority()

    fold.run_fold(_rows(), fold.RunConfig("r", "P1", warmup=50, window=40, interval=60, learner_factory=Majority, retrain=retrain))
    assert asked == [(40, None)] * 4
    quiet = fold.run_fold(_rows(), fold.RunConfig("r", "P1", warmup=50, window=40, interval=60, no_swap=True, timed=True))
    assert [r[13] for r in quiet if r[8]] == [0.0] * 4 and not any(r[7] for r in quiet)


def test_hooks_in_spark(spark):
    df = spark.createDataFrame([(i, x["x"], y, s) for i, x, y, s in _rows()], "tx_index long, x double, y int, segment_key string")
    cfg = fold.RunConfig("r", "P1", warmup=50, window=40, interval=60, learner_factory=lambda: fold.HoeffdingTree(10))
    one, many = (sorted(f(df, ["x"], cfg).collect()) for f in (fold.sequential, fold.prequential))
    assert one == many
    log = reports.adaptation_log(fold.prequential(df, ["x"], cfg), "P1", 60).orderBy("tx_index").collect()
    assert [(r["tx_index"], r["adaptation_event_index"], r["trigger"]) for r in log][:2] == [(109, 0, "P1:periodic:every_60_tx"), (169, 1, "P1:periodic:every_60_tx")]
    named = fold.RunConfig.named("static", "none", p0_mode="frozen", window_size=7)
    assert (named.policy, named.detector, named.frozen, named.window) == ("P0", "adwin", True, 7)
    with pytest.raises(ValueError):
        fold.RunConfig.named("static", "none", p0_mode="other")
