"""Job table, resume, artifacts and configuration of experiment runs.

A job is one row (job_id, status, ...). Resuming is an anti join with the completed ones. Artifacts are JSON files that
are written atomically and checked for completeness before they count.
"""

from __future__ import annotations

import json
import os
import random
import tempfile
import zipfile
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNNING, COMPLETED, FAILED = "RUNNING", "COMPLETED", "FAILED"
#: Keys that a configuration has to have, the values that it allows, and keys of an event experiment's artifact.
REQUIRED = ("experiment_id", "seed", "dataset", "learner", "detector", "policy", "output")
POLICY_TYPES = ("static", "periodic", "global_drift_triggered", "segment_drift_triggered")
LEARNERS = ("hoeffding_tree", "adaptive_random_forest", "logistic_regression", "sgd_classifier")
DETECTOR_TYPES = ("adwin", "hddm", "none")
EVENT_KEYS = ("regime", "seed", "event_centered_metrics")


def atomic_write_json(data: dict, path: str, indent: int = 2) -> None:
    """Written next to its place, flushed to disk, then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=indent)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def job_id(dataset: str, experiment: str, policy: str, seed: int, window: int | None = None, no_swap: bool = False) -> str:
    """The window is left out where it is the default (none or 5000)."""
    return "_".join([dataset, experiment, policy, *([f"W{window}"] if window not in (None, 5000) else []), *(["noswap"] if no_swap else []), f"seed{seed}"])


def artifact_name(policy: str, seed: int, window: int | None = None, no_swap: bool = False) -> str:
    return "_".join(["run", policy, *([f"W{window}"] if window not in (None, 5000) else []), *(["noswap"] if no_swap else []), f"seed{seed}"]) + ".json"


def event_job_id(policy: str, regime: str, window: int, seed: int) -> str:
    return f"e3_{policy}_{regime}_W{window}_seed{seed}"


def is_complete(path: str, *more: str) -> bool:
    """Whether an artifact can be read and has a policy, a final PR-AUC, and the further keys."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    return isinstance(data, dict) and "policy" in data and "pr_auc" in (data.get("final_metrics") or {}) and all(k in data for k in more)


def remaining(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("job_id"), "job_id", "left_anti")


def now() -> str:
    return datetime.now(UTC).isoformat()


def legacy_names(policy: str, seed: int, window: int | None, no_swap: bool = False) -> list[str]:
    """Artifacts that count for a job: its own, and for the default window also the one that names it."""
    own = [artifact_name(policy, seed, window, no_swap)]
    if window in (None, 5000) and policy != "P0":
        own.append("_".join(["run", policy, "W5000", *(["noswap"] if no_swap else []), f"seed{seed}"]) + ".json")
    return own


def latencies_ms(seconds: dict) -> dict:
    """Percentiles with p50_ms, p95_ms and p99_ms (4 digits): those in ms win over those in seconds."""
    out = dict(seconds)
    for p in ("p50", "p95", "p99"):
        out[f"{p}_ms"] = round(seconds.get(f"{p}_ms", seconds.get(p, 0.0) * 1000.0), 4)
    return out


def run_artifact(job: str, run: dict, metrics: dict, latency: dict, adaptations: list[dict], alarms: list[dict], wall_s: float, **more) -> dict:
    """What is kept of a run; ``run`` names experiment, dataset, policy, seed, window_size, no_swap, n_warmup, n_stream.

    ``more`` may hold start_time, end_time, dataset_fingerprint, code_version, config_snapshot, trajectories, and the keys
    of an event experiment. Logs are those of retrains and alarms, never of rows."""
    return {
        "job_id": job, **run, "wall_clock_duration_s": round(wall_s, 3),
        "throughput_tx_per_sec": round(run["n_stream"] / wall_s, 2) if wall_s > 0 else 0.0,
        "config_snapshot": {}, "trajectories": {}, **more,
        "final_metrics": metrics, "latency_percentiles": latencies_ms(latency),
        "adaptation_count": len(adaptations), "adaptation_log": adaptations,
        "drift_event_count": len(alarms), "drift_event_log": alarms,
    }


class Manifest:
    """The jobs of an experiment: RUNNING, then COMPLETED or FAILED; completed work found on disk counts."""

    def __init__(self, folder: str, more_keys: tuple[str, ...] = ()):
        self.folder, self.more = Path(folder), more_keys
        self.path = self.folder / "manifest.json"
        self.jobs: dict[str, dict] = {}
        if self.path.exists():
            try:
                self.jobs = json.loads(self.path.read_text(encoding="utf-8"))["jobs"]
            except (ValueError, KeyError):
                self.jobs = {}

    def save(self) -> None:
        counts = {"total_jobs": len(self.jobs), "completed_jobs": sum(j["status"] == COMPLETED for j in self.jobs.values())}
        atomic_write_json({**counts, "last_updated": now(), "jobs": self.jobs}, str(self.path))

    def start(self, job: str, artifact: str, *older: str) -> bool:
        """False where the job is done already: its artifact, or one under an older name, is whole on disk."""
        for name in (artifact, *older):
            if is_complete(str(self.folder / name), *self.more):
                self.jobs[job] = {**self.jobs.get(job, {}), **self._figures(name), "artifact": name, "status": COMPLETED}
                self.save()
                return False
        self.jobs[job] = {"artifact": artifact, "status": RUNNING, "started": now()}
        self.save()
        return True

    def _figures(self, artifact: str) -> dict:
        data = json.loads((self.folder / artifact).read_text(encoding="utf-8"))
        latency = data.get("latency_percentiles") or {}
        return {
            **{k: data.get(k) for k in ("policy", "seed", "window_size", "no_swap", "wall_clock_duration_s", "throughput_tx_per_sec")},
            **{k: data["final_metrics"].get(k) for k in ("pr_auc", "roc_auc")},
            "adaptation_count": len(data.get("adaptation_log") or []),
            **{f"latency_{p}_ms": latency.get(f"{p}_ms") for p in ("p50", "p95", "p99")},
        }

    def complete(self, job: str, result: dict) -> None:
        entry = self.jobs[job]
        path = str(self.folder / entry["artifact"])
        atomic_write_json(result, path)
        if not is_complete(path, *self.more):
            raise RuntimeError(f"{path} is not a complete artifact")
        entry.update(self._figures(entry["artifact"]), status=COMPLETED, finished=now())
        self.save()
        self.mirror()

    def fail(self, job: str, error: str) -> None:
        self.jobs[job].update(status=FAILED, error=error, finished=now())
        self.save()

    def mirror(self) -> None:
        """A ZIP of the manifest and all completed artifacts, moved to its place when whole; a failure does not stop a run."""
        whole, part = self.folder / "artifacts.zip", self.folder / "artifacts.zip.tmp"
        try:
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
                z.write(self.path, self.path.name)
                for name in (j["artifact"] for j in self.jobs.values() if j["status"] == COMPLETED):
                    z.write(self.folder / name, f"runs/{name}")
            os.replace(part, whole)
        except OSError:
            part.unlink(missing_ok=True)

    def table(self, spark) -> DataFrame:
        """One row a job, with its figures where it is complete."""
        texts, numbers = ("status", "artifact", "policy"), ("pr_auc", "roc_auc", "wall_clock_duration_s", "throughput_tx_per_sec", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms")
        whole = ("seed", "window_size", "adaptation_count")
        rows = []
        for k, v in sorted(self.jobs.items()):
            as_number = [None if v.get(c) is None else float(v[c]) for c in numbers]
            rows.append((k, *(v.get(c) for c in texts), *(v.get(c) for c in whole), *as_number))
        schema = ["job_id string", *(f"{c} string" for c in texts), *(f"{c} long" for c in whole), *(f"{c} double" for c in numbers)]
        return spark.createDataFrame(rows, ", ".join(schema))

    def on_disk(self, spark) -> DataFrame:
        """job_id, artifact, complete of every artifact in the folder."""
        rows = []
        for p in sorted(self.folder.glob("*.json")):
            if p.name != self.path.name:
                try:
                    job = json.loads(p.read_text(encoding="utf-8")).get("job_id")
                except (ValueError, AttributeError):
                    job = None
                rows.append((job or p.stem, p.name, is_complete(str(p), *self.more)))
        return spark.createDataFrame(rows, "job_id string, artifact string, complete boolean")

    def with_artifacts(self, spark) -> DataFrame:
        """job_id, status, artifact, complete: jobs with the artifact that they have on disk, and complete artifacts on
        disk that no job knows."""
        disk, jobs = self.on_disk(spark), self.table(spark).select("job_id", "status", "artifact")
        known = jobs.join(disk.select("artifact", "complete"), "artifact", "left").select("job_id", "status", "artifact", F.coalesce("complete", F.lit(False)).alias("complete"))
        new = disk.where("complete").join(jobs, "artifact", "left_anti").join(jobs, "job_id", "left_anti")
        return known.unionByName(new.select("job_id", F.lit(COMPLETED).alias("status"), "artifact", "complete"))


@dataclass
class ExperimentConfig:
    data: dict

    @classmethod
    def from_yaml(cls, path: str) -> ExperimentConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(yaml.safe_load(f) or {}).validate()

    def save_yaml(self, path: str) -> None:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(self.data, f)

    def validate(self) -> ExperimentConfig:
        d = self.data
        if not isinstance(d, dict):
            raise ValueError("a configuration is a dictionary")
        if missing := [k for k in REQUIRED if k not in d]:
            raise ValueError(f"missing keys {missing}")
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        positive = lambda v: whole(v) and v > 0

        def section(name: str, *keys: str) -> dict:
            if not isinstance(d[name], dict):
                raise ValueError(f"{name} is a dictionary")
            if lost := [k for k in keys if k not in d[name]]:
                raise ValueError(f"{name}: missing keys {lost}")
            return d[name]

        def one_of(name: str, allowed: tuple[str, ...]) -> dict:
            kind = section(name, "type")["type"]
            if kind not in allowed:
                raise ValueError(f"unknown {name} {kind!r}: one of {allowed}")
            return d[name]

        if not whole(d["seed"]) or d["seed"] < 0:
            raise ValueError("seed is a whole number from 0 on")
        fraction = section("dataset", "name", "path", "warmup_fraction")["warmup_fraction"]
        if isinstance(fraction, bool) or not isinstance(fraction, int | float) or not 0 < fraction < 1:
            raise ValueError("warmup_fraction lies between 0 and 1")
        if not isinstance(one_of("learner", LEARNERS).get("params"), dict):
            raise ValueError("learner: params is a dictionary")
        one_of("detector", DETECTOR_TYPES)
        policy = one_of("policy", POLICY_TYPES)
        if policy["type"] == "periodic" and not positive(policy.get("periodic_interval")):
            raise ValueError("a periodic policy needs periodic_interval")
        feature = policy.get("segment_feature")
        if policy["type"] == "segment_drift_triggered" and not (feature and isinstance(feature, str)):
            raise ValueError("a segment policy needs segment_feature")
        if policy["type"] != "static" and not positive(policy.get("adaptation_window_size")):
            raise ValueError("an adaptive policy needs adaptation_window_size")
        if not section("output", "artifact_dir")["artifact_dir"]:
            raise ValueError("output: artifact_dir is empty")
        return self


def set_seed(seed: int) -> None:
    if isinstance(seed, bool) or not isinstance(seed, int) or seed < 0:
        raise ValueError("seed is a whole number from 0 on")
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % 2**32)
