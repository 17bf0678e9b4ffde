"""Detectors and learners as table functions of SQL.

    SELECT * FROM detect(TABLE(records) PARTITION BY segment_key ORDER BY (tx_index), 'error', 'adwin')
    SELECT * FROM prequential(TABLE(stream) PARTITION BY run ORDER BY (tx_index), 'P2', 'hddm_a', 150, 200, 'amount,k')

Each partition has a state of its own and sees its rows in the order that the call names. Columns that are not there and
unknown detectors or policies are refused when the query is analysed; rows that go back in tx_index (a call without an
order) are an error when it runs.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from driftspark.streaming.fold import RECORDS, Fold, RunConfig
from driftspark.streaming.learners import make_detector

INDEX = "tx_index"
_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
#: The columns of a record that a run without a name and a clock has.
_RECORD = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, RECORDS.split(", ")) if name not in ("run_id", "duration_s")])


def _columns(table: AnalyzeArgument, *names: str) -> None:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ... ORDER BY tx_index")
    there = {f.name for f in table.dataType}
    if lost := [n for n in names if n not in there]:
        raise ValueError(f"the table has no column {', '.join(lost)}")


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} is a constant")
    return argument.value


class Detect:
    """tx_index and number (from 0) of each alarm of a detector over a column of errors; null errors are passed over."""

    @staticmethod
    def analyze(table: AnalyzeArgument, error: AnalyzeArgument, detector: AnalyzeArgument) -> AnalyzeResult:
        _columns(table, INDEX, _constant(error, "the error column"))
        make_detector(_constant(detector, "the detector"))
        return AnalyzeResult(T.StructType([T.StructField(INDEX, T.LongType()), T.StructField("alarm", T.LongType())]))

    def __init__(self):
        self.detector, self.n, self.last = None, 0, None

    def eval(self, row: Row, error: str, detector: str):
        if self.detector is None:
            self.detector = make_detector(detector)
        if self.last is not None and row[INDEX] < self.last:
            raise ValueError("the rows of a partition need ORDER BY tx_index")
        self.last = row[INDEX]
        if row[error] is not None and self.detector.update(float(row[error])):
            yield row[INDEX], self.n
            self.n += 1


class Prequential:
    """The records of a run per partition: test, then train, under a policy. Features are numeric columns; null is NaN."""

    @staticmethod
    def analyze(table: AnalyzeArgument, policy: AnalyzeArgument, detector: AnalyzeArgument, warmup: AnalyzeArgument, window: AnalyzeArgument, features: AnalyzeArgument) -> AnalyzeResult:
        names = [f.strip() for f in _constant(features, "the list of features").split(",")]
        _columns(table, INDEX, "y", "segment_key", *names)
        RunConfig("", _constant(policy, "the policy"), _constant(detector, "the detector"), _constant(warmup, "the warmup"), _constant(window, "the window"))
        return AnalyzeResult(_RECORD)

    def __init__(self):
        self.fold, self.last = None, None

    def eval(self, row: Row, policy: str, detector: str, warmup: int, window: int, features: str):
        if self.fold is None:
            self.fold, self.features = Fold(RunConfig("", policy, detector, warmup, window, interval=window)), [f.strip() for f in features.split(",")]
        if self.last is not None and row[INDEX] < self.last:
            raise ValueError("the rows of a partition need ORDER BY tx_index")
        self.last = row[INDEX]
        x = {f: float("nan") if row[f] is None else float(row[f]) for f in self.features}
        if (record := self.fold.step(row[INDEX], x, int(row["y"]), row["segment_key"])) is not None:
            yield record[1:-1]


def register(spark: SparkSession) -> None:
    """Makes detect and prequential known to the session's SQL."""
    spark.udtf.register("detect", udtf(Detect))
    spark.udtf.register("prequential", udtf(Prequential))
