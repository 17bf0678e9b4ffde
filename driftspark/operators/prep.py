"""Leakage-safe preprocessing: fitted on a warmup prefix, applied to everything as one projection.

The fit is a selection of exact medians, all columns in each of its passes, plus one job for all vocabularies; the fitted state is small (a row per column, a row per
category) and is kept as plain values, so the transform stays a single code-generated stage. Vocabularies beyond
``INLINE`` categories stay tables, which no driver holds, and are joined; a join side is broadcast by size, by the
planner. Only saving the state as JSON brings them to the driver.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.functions.quantiles import quantiles
from driftspark.plans.layout import written

INLINE = 256
#: The segment column of each dataset type.
SEGMENTS = {"ieee_cis": "ProductCD", "paysim": "type", "ulb": None}


def feature_columns(df: DataFrame, target: str, temporal: str, ident: str | None) -> list[str]:
    """Columns in their order, without target, time and identifier."""
    return [c for c in df.columns if c not in {target, temporal, ident}]


def split_columns(df: DataFrame, features: list[str], custom: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numerical): strings and named columns are categorical, booleans are numerical."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return [c for c in features if c in text or c in custom], [c for c in features if c not in text and c not in custom]


def number(c: str | Column) -> Column:
    """A feature as double, NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def fit_numeric(warmup: DataFrame, columns: list[str]) -> DataFrame:
    """column, median, mean, std (population): over non-null warmup values; all null gives 0, 0, 1; no spread gives 1."""
    if not columns:
        return warmup.sparkSession.createDataFrame([], "column string, median double, mean double, std double")
    spark = warmup.sparkSession
    found = quantiles(warmup, columns, (0.5,)).withColumnRenamed("column", "_column")
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    rows = names.join(found, names["column"] == found["_column"], "left")
    return rows.select(
        "column",
        F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)).alias("median"),
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("std"),
    )


def fit_vocabulary(warmup: DataFrame, columns: list[str]) -> DataFrame:
    """column, category, code: distinct non-null warmup values in byte order, codes from 1 (0 is unknown)."""
    if not columns:
        return warmup.sparkSession.createDataFrame([], "column string, category string, code int")
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in columns]
    values = warmup.select(F.inline(F.array(*pairs))).where("category is not null").distinct()
    rank = F.row_number().over(Window.partitionBy("column").orderBy("category"))
    return values.select("column", "category", rank.cast("int").alias("code"))


@dataclass
class Preprocessor:
    """fit / transform with a state that can be saved as JSON."""

    dataset_type: str
    target: str
    temporal: str
    ident: str | None = None
    custom_categorical: tuple[str, ...] = ()
    features: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    numeric: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    vocabularies: dict[str, dict[str, int]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, warmup: DataFrame) -> Preprocessor:
        self.features = feature_columns(warmup, self.target, self.temporal, self.ident)
        self.categorical, numerical = split_columns(warmup, self.features, self.custom_categorical)
        self.numeric = {r["column"]: (r["median"], r["mean"], r["std"]) for r in fit_numeric(warmup, numerical).collect()}
        self.vocabularies, self.tables = {c: {} for c in self.categorical}, {}
        if self.categorical:
            codes = written(fit_vocabulary(warmup, self.categorical), "vocabulary")
            large = [r["column"] for r in codes.groupBy("column").count().where(F.col("count") > INLINE).collect()]
            self.tables = {c: codes.where(F.col("column") == c).select("category", "code") for c in large}
            for r in codes.where(~F.col("column").isin(large)).collect():  # INLINE rows a column at most
                self.vocabularies[r["column"]][r["category"]] = r["code"]
        return self

    def transform(self, df: DataFrame, *keep: str, scale: bool = False) -> DataFrame:
        """The columns in ``keep``, all features in fitted order, y, and segment_key (absent where it is declared but
        not in the input). Features missing from the input are their median, or 0 for categories."""
        if not self.features:
            raise ValueError("fit first")
        out: list[Column] = [F.col(c) for c in keep]
        joined = df
        for c in self.features:
            if c in self.numeric:
                median, mean, std = self.numeric[c]
                x = F.coalesce(number(c), F.lit(median)) if c in df.columns else F.lit(median)
                out.append((((x - mean) / std) if scale else x).alias(c))
            elif c not in df.columns:
                out.append(F.lit(0).alias(c))
            elif c not in self.tables and len(self.vocabularies[c]) <= INLINE:
                out.append(encode(F.col(c), self.vocabularies[c]).alias(c))
            else:
                table = self.tables.get(c)
                if table is None:  # from a state in JSON
                    table = df.sparkSession.createDataFrame(list(self.vocabularies[c].items()), "category string, code int")
                table = table.select(F.col("category").alias(f"_{c}"), F.col("code").alias(f"_{c}_code"))
                joined = joined.join(table, joined[c].cast("string") == table[f"_{c}"], "left")
                out.append(F.coalesce(F.col(f"_{c}_code"), F.lit(0)).alias(c))
        if self.target in df.columns:
            out.append(F.col(self.target).cast("int").alias("y"))
        if (segment := segment_key(df, self.dataset_type)) is not None:
            out.append(segment.alias("segment_key"))
        return joined.select(*out)

    def fit_transform(self, warmup: DataFrame, *keep: str, scale: bool = False) -> DataFrame:
        return self.fit(warmup).transform(warmup, *keep, scale=scale)

    def to_dict(self) -> dict:
        state = {k: list(v) if isinstance(v, tuple) else v for k, v in self.__dict__.items() if k != "tables"}
        rows = lambda table: {r["category"]: r["code"] for r in table.orderBy("code").collect()}
        return {**state, "vocabularies": {**self.vocabularies, **{c: rows(t) for c, t in self.tables.items()}}}

    @classmethod
    def from_dict(cls, state: dict) -> Preprocessor:
        state = dict(state)
        state["custom_categorical"] = tuple(state.get("custom_categorical", ()))
        state["numeric"] = {k: tuple(v) for k, v in state["numeric"].items()}
        return cls(**state)

    def save_state(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    @classmethod
    def load_state(cls, path: str) -> Preprocessor:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))


def encode(c: Column, codes: dict[str, int]) -> Column:
    """Codes of categories; null and unseen ones are 0."""
    if not codes:
        return F.lit(0)
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(c.cast("string"), F.lit(""))), F.lit(0))


def segment_key(df: DataFrame, dataset_type: str) -> Column | None:
    """The segment as text; null reads 'nan', a dataset without one has 'all'."""
    name = SEGMENTS.get(dataset_type)
    if name is None:
        return F.lit("all")
    return F.coalesce(F.col(name).cast("string"), F.lit("nan")) if name in df.columns else None


def warmup_rows(n: int, fraction: float) -> int:
    w = int(n * fraction)
    if not 0 <= w < n:
        raise ValueError("warmup has to leave rows to stream")
    return w
