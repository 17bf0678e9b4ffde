"""The test-then-train fold under four adaptation policies, in grouped Arrow tasks.

P0 learns on every row (or is frozen), P1 retrains every N rows, P2 on a global alarm, P3 on an alarm of the row's own
segment with one learner per segment. Per row: predict, record, learn, update detectors, add to the window, apply the
policy, swap. A retrain fits a fresh learner on the last W rows (of the segment, for P3) and includes the current one;
the swapped model first predicts the next row.

What runs in parallel without changing results: runs; the epochs of P1 (an epoch's model is a function of the W rows up
to its trigger and its own rows); the segments of P3 (each reads only its own state). P0 and P2 are sequential by nature.
Alarms of P1 and global alarms of P3 never feed back, so they are a second pass over the error column. A global detector
reads its errors in order, so that pass is one task at a time; it holds a batch of rows. A frozen model makes rows
independent: one task learns the warmup rows, all others score.

What is sequential goes in slices of the index, a job each, and hands its state to the next one (``in_slices``): no task
sorts more than a slice, however long the stream is.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from time import perf_counter

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.plans.layout import scratch, written
from driftspark.streaming.learners import DriftMonitor, HoeffdingTree, make_detector

POLICIES = {"static": "P0", "periodic": "P1", "global_drift_triggered": "P2", "segment_drift_triggered": "P3"}
DETECTORS = {"hddm": "hddm_w", "none": "adwin"}
RECORDS = (
    "run_id string, tx_index long, y_true int, y_prob double, y_pred int, error int, segment_key string, adapted boolean, "
    "adaptation_scope string, drift_detected_global boolean, drift_detected_segment boolean, n_window int, n_fraud_window int, duration_s double"
)


@dataclass(frozen=True)
class RunConfig:
    run_id: str
    policy: str = "P0"
    detector: str = "adwin"
    warmup: int = 0
    window: int = 5000
    interval: int = 10_000
    grace_period: int = 200
    delta: float = 1e-7
    frozen: bool = False
    no_swap: bool = False
    detector_kwargs: dict = field(default_factory=dict)
    #: Makes a learner: anything with predict_one, learn_one and fit_batch. None: the Hoeffding tree.
    learner_factory: Callable | None = None
    #: Makes the model that replaces another, from the window: retrain(buffer, segment_key=...). None: a fresh learner's fit.
    retrain: Callable | None = None
    #: Measures retrains (duration_s); by the sequential plan only.
    timed: bool = False

    def __post_init__(self):
        object.__setattr__(self, "policy", POLICIES.get(self.policy, self.policy))
        object.__setattr__(self, "detector", DETECTORS.get(self.detector, self.detector))
        if self.policy not in POLICIES.values():
            raise ValueError(f"unknown policy {self.policy!r}")
        if self.interval <= 0 or self.window <= 0:
            raise ValueError("interval and window are positive")
        make_detector(self.detector, **self.detector_kwargs)

    def learner(self):
        return self.learner_factory() if self.learner_factory else HoeffdingTree(self.grace_period, self.delta)

    @classmethod
    def named(cls, policy: str, detector: str, grace_period: int = 200, delta: float = 1e-7, window_size: int = 5000, n_interval: int = 10_000, p0_mode: str = "incremental", seed: int = 42, **more) -> RunConfig:
        """A configuration by the names of an experiment file; ``p0_mode`` is incremental or frozen."""
        if p0_mode not in ("incremental", "frozen"):
            raise ValueError(f"p0_mode is incremental or frozen, not {p0_mode!r}")
        run = f"{POLICIES.get(policy, policy)}_seed{seed}"
        return cls(run, policy, detector, grace_period=grace_period, delta=delta, window=window_size, interval=n_interval, frozen=p0_mode == "frozen", **more)


class Retrainer:
    """The last W rows of the stream, warmup included, and fits on them or on one segment's rows among them."""

    def __init__(self, cfg: RunConfig):
        self.cfg, self.rows = cfg, deque()

    def add(self, tx_index: int, x: dict, y: int, segment: str | None) -> None:
        self.rows.append((tx_index, x, y, segment))
        while self.rows[0][0] <= tx_index - self.cfg.window:
            self.rows.popleft()

    def window(self, segment: str | None = None) -> list[tuple[dict, int]]:
        return [(x, y) for _, x, y, s in self.rows if segment is None or s == segment]

    def fit(self, segment: str | None = None):
        """The model that replaces another; by the configuration's own function, if it has one."""
        if self.cfg.retrain:
            return self.cfg.retrain(self, segment_key=segment)
        if not (rows := self.window(segment)):
            raise RuntimeError("no rows to retrain on")
        model = self.cfg.learner()
        return model.fit_batch(rows) or model

    def reset(self) -> None:
        self.rows.clear()


class Fold:
    """The state of a run between two rows: models (by segment for P3, else one), detectors and the window."""

    def __init__(self, cfg: RunConfig, kept: tuple | None = None):
        self.cfg, self.by_segment = cfg, cfg.policy == "P3"
        self.models: dict[str | None, HoeffdingTree] = {}
        self.monitor = DriftMonitor(cfg.detector, True, cfg.detector_kwargs)
        self.buffer = Retrainer(cfg)
        if kept is not None:
            self.models, self.monitor, self.buffer.rows = kept

    def kept(self) -> tuple:
        """What another fold of the same configuration goes on from."""
        return self.models, self.monitor, self.buffer.rows

    def step(self, tx: int, x: dict, y: int, segment: str | None) -> tuple | None:
        """The record of a row; a row before cfg.warmup only trains and has none."""
        cfg, key = self.cfg, segment if self.by_segment else None
        if key not in self.models:
            self.models[key] = cfg.learner()
        model = self.models[key]
        if tx < cfg.warmup:
            model.learn_one(x, y)
            self.buffer.add(tx, x, y, segment)
            return None
        p = model.predict_one(x)
        label = int(p >= 0.5)
        error = abs(y - label)
        if not (cfg.policy == "P0" and cfg.frozen):
            model.learn_one(x, y)
        whole, part = self.monitor.update(error, tx, segment)
        self.buffer.add(tx, x, y, segment)
        due = {
            "P0": False,
            "P1": (tx - cfg.warmup + 1) % cfg.interval == 0,
            "P2": whole,
            "P3": part and segment is not None,
        }[cfg.policy]
        scope = (segment if self.by_segment else "global") if due else None
        n = frauds = seconds = None
        if due:
            window = self.buffer.window(segment if self.by_segment else None)
            n, frauds = len(window), sum(v for _, v in window)
            began = perf_counter()
            if not cfg.no_swap:
                self.models[key] = self.buffer.fit(segment if self.by_segment else None)
            if cfg.timed:
                seconds = 0.0 if cfg.no_swap else perf_counter() - began
        return cfg.run_id, tx, y, p, label, error, segment, due and not cfg.no_swap, scope, whole, part, n, frauds, seconds


def run_fold(rows, cfg: RunConfig) -> list[tuple]:
    """Records of rows (tx_index, features, y, segment) in order; rows before cfg.warmup only train."""
    state = Fold(cfg)
    return [record for row in rows if (record := state.step(*row)) is not None]


_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


def _frame(records: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=_COLUMNS)
    for c in ("n_window", "n_fraud_window"):
        out[c] = out[c].astype("Int64")
    out["duration_s"] = out["duration_s"].astype(float)
    return out


def _rows(pdf: pd.DataFrame, features: list[str]):
    pdf = pdf.sort_values("tx_index", kind="stable")
    xs = pdf[features].to_numpy(float)
    segments = [None if s is None or s != s else s for s in pdf["segment_key"]]
    for tx, x, y, s in zip(pdf["tx_index"].tolist(), xs.tolist(), pdf["y"].tolist(), segments, strict=True):
        yield tx, dict(zip(features, x, strict=True)), int(y), s


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in RECORDS.split(", ")])


def in_order(df: DataFrame, *key: str, index: str = "tx_index"):
    """Groups of a frame by ``key`` whose rows come in the order of ``index``, for functions over an iterator of batches."""
    return df.repartition(*key).sortWithinPartitions(*key, index).groupBy(*key)


def _ordered(batches: Iterator[pa.RecordBatch], index: str = "tx_index") -> Iterator[pd.DataFrame]:
    """Batches as frames; rows that are out of order are an error, never folded."""
    last = None
    for b in batches:
        pdf = b.to_pandas()
        if len(pdf):
            at = pdf[index]
            if not at.is_monotonic_increasing or (last is not None and at.iloc[0] < last):
                raise RuntimeError(f"rows of a group are not in the order of {index}")
            last = at.iloc[-1]
            yield pdf


#: Index values of a slice.
SLICE = 1 << 20


def in_slices(rows: DataFrame, keys: list[str], begin: Callable, step: Callable, kept: Callable, schema: pa.Schema, columns: str, index: str = "tx_index") -> DataFrame:
    """Folds each group of ``keys`` (strings) in the order of ``index``; ``columns`` names what comes out, as ``schema`` does.

    Rows are written by slice of SLICE index values. Each slice is a job over its own rows only and hands every group's
    state to the next, so a task sorts one slice of its groups, not the whole stream, and holds a batch of rows.
    ``begin(key, state)`` makes a group's state, anew (None) or from ``kept`` of the slice before, which has to be
    picklable; ``step(state, frame)`` changes it and returns a record batch."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "slices")
    rows.withColumn("_slice", F.floor(F.col(index) / SLICE)).write.partitionBy("_slice").parquet(f"{path}/rows")
    table = spark.read.schema(rows.schema.add("_slice", "long")).parquet(f"{path}/rows")
    slices = [r["_slice"] for r in table.select("_slice").distinct().collect()]
    if None in slices:
        raise ValueError(f"rows without {index}")
    names, held = rows.columns, [f"_of_{k}" for k in keys]
    mixed = ", ".join([columns, *(f"{h} string" for h in held), "_state binary"])
    arrow = pa.schema([*schema, *((h, pa.string()) for h in held), ("_state", pa.binary())])
    if not slices:
        return spark.createDataFrame([], columns)

    def folds(hands_on: bool) -> Callable:
        def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, state = tuple(k.as_py() for k in key), None

            def own() -> Iterator[pa.RecordBatch]:
                nonlocal state
                for b in batches:
                    if state is None and b.num_rows:  # the state handed on has no index and comes first
                        old = b.column("_state")[0].as_py()
                        state = begin(group, None if old is None else cloudpickle.loads(old))
                        b = b if old is None else b.slice(1)
                    yield b.select(names)

            for pdf in _ordered(own(), index):
                out = step(state, pdf)
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(len(out), f.type) for f in list(arrow)[len(schema) :])], schema=arrow)
            if hands_on and state is not None:
                last = [*(None for _ in schema), *group, cloudpickle.dumps(kept(state))]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, arrow, strict=True)], schema=arrow)

        return fold

    states = None
    for at in sorted(slices):
        part = table.where(F.col("_slice") == at).select(*names, F.lit(None).cast("binary").alias("_state"))
        part = part if states is None else part.unionByName(states, allowMissingColumns=True)
        in_order(part, *keys, index=index).applyInArrow(folds(at != max(slices)), mixed).write.parquet(f"{path}/out/slice={at}")
        states = spark.read.schema(mixed).parquet(f"{path}/out/slice={at}").where("_state is not null").select(*(F.col(h).alias(k) for h, k in zip(held, keys, strict=True)), "_state")
    return spark.read.schema(mixed).parquet(f"{path}/out").where("_state is null").select(*schema.names)


def _recorded(state: Fold, pdf: pd.DataFrame, features: list[str]) -> pd.DataFrame:
    return _frame([r for row in _rows(pdf, features) if (r := state.step(*row)) is not None])


def _batch(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, _ARROW, preserve_index=False)


def sequential(stream: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """One task per run at a time: the only way for P0 and P2, and the yardstick for the others. It sorts a slice of the
    stream and holds one batch of rows."""
    rows = _needed(stream, features).withColumn("run", F.lit(cfg.run_id))
    return in_slices(rows, ["run"], lambda _, kept: Fold(cfg, kept), lambda state, pdf: _batch(_recorded(state, pdf, features)), Fold.kept, _ARROW, RECORDS)


#: Largest fitted model that is broadcast.
MODEL_BYTES = 64 << 20


def frozen(stream: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """P0 with a frozen model: one task learns the warmup rows, the model goes to all tasks, and rows are scored where they
    are. ``prequential`` adds the alarms. A model beyond MODEL_BYTES is an error."""
    rows = _needed(stream, features)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cfg.learner()
        for pdf in _ordered(batches):
            for _, x, y, _ in _rows(pdf, features):
                model.learn_one(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    warm = rows.where(F.col("tx_index") < cfg.warmup).withColumn("one", F.floor(F.col("tx_index") / (cfg.warmup + 1)))
    fitted = in_order(warm, "one").applyInArrow(learn, "model binary").where(F.octet_length("model") <= MODEL_BYTES).collect()
    if cfg.warmup and not fitted and warm.limit(1).collect():
        raise ValueError(f"the fitted model is larger than {MODEL_BYTES} bytes")
    model = stream.sparkSession.sparkContext.broadcast(bytes(fitted[0]["model"]) if fitted else pickle.dumps(cfg.learner()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = pickle.loads(model.value)
        for b in batches:
            out = []
            for tx, x, y, s in _rows(b.to_pandas(), features):
                p = fixed.predict_one(x)
                label = int(p >= 0.5)
                out.append((cfg.run_id, tx, y, p, label, abs(y - label), s, False, None, None, None, None, None, None))
            yield pa.RecordBatch.from_pandas(_frame(out), _ARROW, preserve_index=False)

    return rows.where(F.col("tx_index") >= cfg.warmup).mapInArrow(score, RECORDS)


def _needed(stream: DataFrame, features: list[str]) -> DataFrame:
    return stream.select("tx_index", "y", "segment_key", *(F.col(f).cast("double").alias(f) for f in features))


def _epoch(model, pdf: pd.DataFrame, features: list[str], cfg: RunConfig) -> pd.DataFrame:
    """Records of an epoch's rows, and without one those that it only trains on, which come before."""
    out = []
    for learns, (tx, x, y, s) in zip(pdf["train"].tolist(), _rows(pdf, features), strict=True):
        if learns:
            model.learn_one(x, y)
            continue
        p = model.predict_one(x)
        label = int(p >= 0.5)
        model.learn_one(x, y)
        epoch_end = (tx - cfg.warmup + 1) % cfg.interval == 0
        swap = epoch_end and not cfg.no_swap
        out.append((cfg.run_id, tx, y, p, label, abs(y - label), s, swap, "global" if epoch_end else None, None, None, None, None, None))
    return _frame(out)


def epochs(stream: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """P1 by epoch: rows of the W before an epoch's trigger are copied to it as training rows. ``prequential`` adds the
    alarms; n_window and n_fraud_window are the rows that the next epoch trains on."""
    after = F.col("tx_index") - cfg.warmup
    own = F.greatest(F.floor(after / cfg.interval), F.lit(0)).cast("long")
    # epoch k > 0 trains on rows (trigger - W, trigger], trigger = warmup + k * interval - 1
    low = F.greatest(F.floor(after / cfg.interval) + 1, F.lit(1)).cast("long")
    high = F.floor((after + cfg.window) / cfg.interval).cast("long")
    train = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    base = _needed(stream, features).where(F.col("tx_index").isNotNull())
    last = base.agg(F.max(own)).first()[0]
    trained = base.withColumn("epoch", F.explode(train))
    training = trained.where(F.col("epoch") <= F.lit(last)).withColumn("train", F.lit(True))
    rows = base.withColumn("epoch", own).withColumn("train", F.col("tx_index") < cfg.warmup).unionByName(training)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cfg.learner()
        for pdf in _ordered(batches):
            yield _batch(_epoch(model, pdf, features, cfg))

    sizes = trained.groupBy((cfg.warmup + F.col("epoch") * cfg.interval - 1).alias("tx_index")).agg(
        F.count("*").cast("int").alias("n_window"), F.sum("y").cast("int").alias("n_fraud_window")
    )
    # the first epoch learns all warmup rows, a share of the stream; the others are bounded by window and interval
    first = in_slices(rows.where("epoch = 0").withColumn("run", F.lit(cfg.run_id)), ["run"], lambda _, kept: cfg.learner() if kept is None else kept, lambda model, pdf: _batch(_epoch(model, pdf, features, cfg)), lambda model: model, _ARROW, RECORDS)
    others = in_order(rows.where("epoch > 0"), "epoch").applyInArrow(fold, RECORDS)
    out = first.unionByName(others).drop("n_window", "n_fraud_window")
    return out.join(sizes, "tx_index", "left").select(*_COLUMNS)


def by_segment(stream: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """P3 by segment: each reads only its own state; a window still ends W global rows back, by tx_index. A task sorts a
    slice of a segment and holds a batch of rows. ``prequential`` adds the global alarms."""

    def step(state: Fold, pdf: pd.DataFrame) -> pa.RecordBatch:
        out = _recorded(state, pdf, features)
        out["drift_detected_global"] = None
        return _batch(out)

    return in_slices(_needed(stream, features), ["segment_key"], lambda _, kept: Fold(cfg, kept), step, Fold.kept, _ARROW, RECORDS)


def _hits(rows: DataFrame, keys: list[str], detector: Callable) -> DataFrame:
    """keys, tx_index of the alarms of ``detector(key)``'s pass over the errors of each group of keys (strings), in order, a
    batch at a time."""

    def step(state: tuple, pdf: pd.DataFrame) -> pa.RecordBatch:
        group, d = state
        hits = [t for t, e in zip(pdf["tx_index"].tolist(), pdf["error"].tolist(), strict=True) if d.update(float(e))]
        return pa.RecordBatch.from_arrays([*(pa.array([k] * len(hits), pa.string()) for k in group), pa.array(hits, pa.int64())], schema=schema)

    schema = pa.schema([*((k, pa.string()) for k in keys), ("tx_index", pa.int64())])
    columns = ", ".join([*(f"{k} string" for k in keys), "tx_index long"])
    needed = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), "tx_index", F.col("error").cast("double").alias("error"))
    return in_slices(needed, keys, lambda group, kept: (group, detector(group) if kept is None else kept), step, lambda state: state[1], schema, columns)


def _passes(rows: DataFrame, key: str, detector: str, kwargs: dict) -> DataFrame:
    """key, tx_index of the alarms of a detector's pass over the errors of each key."""
    return _hits(rows, [key], lambda _: make_detector(detector, **kwargs))


def alarms(records: DataFrame, detector: str = "adwin", by: str | None = None) -> DataFrame:
    """stream_key, tx_index, detector_type: a detector's pass over the error column, global or per value of ``by``."""
    key = F.lit("global") if by is None else F.col(by)
    found = _passes(records.withColumn("stream_key", key), "stream_key", detector, {})
    return found.select("stream_key", "tx_index", F.lit(detector).alias("detector_type"))


def _with_alarms(records: DataFrame, cfg: RunConfig, by: dict[str, str | None]) -> DataFrame:
    """Records with the alarm columns named in ``by`` from passes over the error column, global (None) or per value of a
    column, whose null has no detector."""
    records = written(records, "records")
    out = records.drop(*by)
    for name, key in by.items():
        of = F.lit("global") if key is None else F.col(key)
        rows = records.withColumn("of", of).where("of is not null")
        hits = _passes(rows, "of", cfg.detector, cfg.detector_kwargs).select("tx_index", F.lit(True).alias(name))
        out = out.join(hits, "tx_index", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select(*_COLUMNS)


def prequential(stream: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """Records of a run by the widest plan that its policy allows; equal to the sequential fold in every column."""
    if cfg.timed:
        return sequential(stream, features, cfg)
    if cfg.policy == "P1" and not cfg.no_swap and not cfg.retrain:  # without a swap, a model outlives its epoch
        both = {"drift_detected_global": None, "drift_detected_segment": "segment_key"}
        return _with_alarms(epochs(stream, features, cfg), cfg, both)
    if cfg.policy == "P0" and cfg.frozen:
        return _with_alarms(frozen(stream, features, cfg), cfg, {"drift_detected_global": None, "drift_detected_segment": "segment_key"})
    if cfg.policy == "P3":
        return _with_alarms(by_segment(stream, features, cfg), cfg, {"drift_detected_global": None})
    return sequential(stream, features, cfg)
