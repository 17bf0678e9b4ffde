"""Dataset profiles: missing cells, duplicate rows, cardinality, class mix. One aggregate per table, unpivoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(df: DataFrame) -> DataFrame:
    """column, n_missing, pct_missing."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.count("*").alias("n")) for c in df.columns]
    rows = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    return rows.select("column", "n_missing", F.coalesce(100.0 * F.col("n_missing") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("pct_missing"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_duplicates (rows after the first equal one; nulls are equal), pct."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    ).withColumn("pct", F.coalesce(100.0 * F.col("n_duplicates") / F.nullif("n_rows", F.lit(0)), F.lit(0.0)))


def cardinality(df: DataFrame) -> DataFrame:
    """column, n_unique (null counts as a value), bucket. Columns are counted one group at a time from (column, value)
    pairs, so no row is copied once per column inside an expansion of distinct aggregates."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns))
    values = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.lit(1).alias("one"))
    counts = values.groupBy("column").agg(F.count("*").alias("n_unique"))
    n = F.col("n_unique")
    bucket = F.when(n <= 1, "constant").when(n == 2, "binary").when(n <= 20, "low").otherwise("high")
    return counts.select("column", "n_unique", bucket.alias("bucket"))


def class_mix(df: DataFrame, label: str) -> DataFrame:
    """label, n, pct (4 digits): shares of the whole."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def stream_stats(df: DataFrame, temporal: str, label: str, segment: str) -> DataFrame:
    """One row: first and last time, rate of positives, sorted segments."""
    return df.agg(
        F.min(temporal).alias("first"),
        F.max(temporal).alias("last"),
        F.avg(label).alias("rate"),
        F.array_join(F.sort_array(F.collect_set(segment)), ",").alias("segments"),
    )
