"""The fold over a stream that never ends: state by key in Spark's state store, and a replay that survives restarts.

Each part of a run's state has its own variable in the store: models and segment detectors are maps, the window is a list,
the global detector and the last index are values. A batch rewrites what it has touched. The store's checkpoint and the
sink's commit log make a restart go on where the last committed batch ended; rows at or before a key's last index are
refused, so a file that is delivered twice changes nothing.

P3 is keyed by segment, and so has as many tasks as there are segments; a row's global alarm needs all segments and is null.
P0, P1 and P2 have one model that sees all rows, so their key is the run, and runs are what is parallel.

A micro-batch can be as large as all that has arrived. Its rows are put into order in stretches, which a task keeps on its
own disk and merges, and records leave as they are made: the Python side holds a few batches of a key, not all its rows.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from driftspark.streaming.fold import RECORDS, Fold, RunConfig, _frame, _needed, _rows

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a key that are sorted in memory, and rows of a batch of them on disk.
STRETCH, BATCH = 1 << 18, 1 << 13


def in_index_order(frames: Iterator[pd.DataFrame], schema: pa.Schema, index: str = "tx_index") -> Iterator[pd.DataFrame]:
    """The rows of frames in the order of ``index``; of equal ones the first to come is the first. Up to STRETCH rows are sorted in memory, more
    are sorted stretch by stretch into a file, of which a batch per stretch is held."""
    part: list[pd.DataFrame] = []
    spans: list[list[int]] = []  # each stretch's next batch and end in the file
    with tempfile.TemporaryFile() as file, pa.ipc.new_file(file, schema) as writer:

        def spill() -> None:
            done = spans[-1][1] if spans else 0
            rows = pa.Table.from_pandas(pd.concat(part).sort_values(index, kind="stable"), schema, preserve_index=False).combine_chunks()
            batches = rows.to_batches(BATCH)
            for b in batches:
                writer.write_batch(b)
            spans.append([done, done + len(batches)])
            part.clear()

        for pdf in frames:
            if part and sum(map(len, part)) + len(pdf) > STRETCH:
                spill()
            part.append(pdf[schema.names])
        if not spans:
            if part:
                yield pd.concat(part).sort_values(index, kind="stable")
            return
        spill()
        writer.close()
        file.seek(0)
        stored, heads = pa.ipc.open_file(file), [None] * len(spans)
        while True:
            for i, (at, end) in enumerate(spans):
                if heads[i] is None and at < end:
                    heads[i], spans[i][0] = stored.get_batch(at).to_pandas(), at + 1
            if not (open_ := [h for h in heads if h is not None]):
                return
            # up to the first end of a batch all rows are at hand
            bound = min(h[index].iloc[-1] for h in open_)
            ready = []
            for i, h in enumerate(heads):
                if h is not None and (n := int(h[index].searchsorted(bound, "right"))):
                    ready.append(h.iloc[:n])
                    heads[i] = h.iloc[n:] if n < len(h) else None
            yield pd.concat(ready).sort_values(index, kind="stable")


class FoldProcessor(StatefulProcessor):
    """The fold of one key, with its state in variables of the store."""

    def __init__(self, features: list[str], cfg: RunConfig):
        self.features, self.cfg = features, cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tx_index long")
        self.whole = handle.getValueState("whole", "detector binary")
        self.models = handle.getMapState("models", "segment string", "model binary")
        self.parts = handle.getMapState("parts", "segment string", "detector binary")
        self.window = handle.getListState("window", "tx_index long, y int, segment string, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = self._load(), self.last.get()[0] if self.last.exists() else None
        schema = pa.schema([("tx_index", pa.int64()), ("y", pa.int32()), ("segment_key", pa.string()), *((f, pa.float64()) for f in self.features)])
        touched = set()
        for batch in in_index_order(rows, schema):
            fresh = batch if last is None else batch[batch["tx_index"] > last]
            fresh = fresh.drop_duplicates("tx_index")
            for start in range(0, len(fresh), BATCH):
                out = []
                for tx, x, y, s in _rows(fresh.iloc[start : start + BATCH], self.features):
                    touched.add(s)
                    last = tx
                    if (record := state.step(tx, x, y, s)) is not None:
                        out.append(record)
                yield _frame(out)
        if touched:
            self._save(state, touched, last)

    def _load(self) -> Fold:
        state = Fold(self.cfg)
        for (name,), (model,) in self.models.iterator():
            state.models[_segment(name)] = pickle.loads(model)
        if self.whole.exists():
            state.monitor.whole = pickle.loads(self.whole.get()[0])
        for (name,), (detector,) in self.parts.iterator():
            state.monitor.by_segment[_segment(name)] = pickle.loads(detector)
        if self.window.exists():
            for tx, y, s, x in self.window.get():
                state.buffer.rows.append((tx, dict(zip(self.features, x, strict=True)), y, s))
        return state

    def _save(self, state: Fold, touched: set, last: int) -> None:
        self.last.update((int(last),))
        self.whole.update((pickle.dumps(state.monitor.whole),))
        for s in touched:
            model = s if state.by_segment else None
            self.models.updateValue((_name(model),), (pickle.dumps(state.models[model]),))
            if s in state.monitor.by_segment:
                self.parts.updateValue((_name(s),), (pickle.dumps(state.monitor.by_segment[s]),))
        self.window.put([(int(tx), int(y), s, [float(x[f]) for f in self.features]) for tx, x, y, s in state.buffer.rows])


def _name(segment: str | None) -> str:
    return "" if segment is None else f"={segment}"


def _segment(name: str) -> str | None:
    return name[1:] if name else None


def stateful(source: DataFrame, features: list[str], cfg: RunConfig) -> DataFrame:
    """RECORDS of a streaming run, under any policy. Rows of one micro-batch are put into order; rows that an earlier batch
    has passed are refused. For P3, the global alarm is null, as is ``drift_detected_global`` of ``fold.by_segment``.

    The session's state store has to be RocksDB (PROVIDER), which alone has lists and maps; anything else is an error."""
    spark = source.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"{PROVIDER} has to be {ROCKSDB}")
    rows = _needed(source, features)
    keyed = rows.groupBy("segment_key") if cfg.policy == "P3" else rows.withColumn("run", F.when(F.col("tx_index").isNotNull(), cfg.run_id)).groupBy("run")
    out = keyed.transformWithStateInPandas(FoldProcessor(features, cfg), RECORDS, "append", "none")
    return out.withColumn("drift_detected_global", F.lit(None).cast("boolean")) if cfg.policy == "P3" else out


def to_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream to a Parquet table, each row exactly once across restarts with the same ``checkpoint``."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replay(source: DataFrame, order: str, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Streams a source through ``sink(rows in order, batch_id)``; rows at or before the last index that an earlier batch
    has passed on are refused, after a restart with the same ``checkpoint``, too.

    The last index of every batch is a table below the checkpoint. A batch that is repeated because it failed before its
    commit reads the indices of the batches before it, so it passes on the same rows under the same batch_id."""
    seen, kind = f"{checkpoint.rstrip('/')}/last_index", dict(source.dtypes)[order]

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        last = session.read.schema(f"last {kind}, batch long").parquet(seen).where(F.col("batch") < batch_id).agg(F.max("last")).first()[0] if _exists(session, seen) else None
        kept = df if last is None else df.where(F.col(order) > last)
        top = kept.agg(F.max(order)).first()[0]
        if top is None:
            return
        sink(kept.orderBy(order), batch_id)
        session.range(1).select(F.lit(top).cast(kind).alias("last")).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
