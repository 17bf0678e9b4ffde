"""Physical layout helpers: scratch tables, a dense global row index, and windows over it without a global sort.

``tx_index`` is semantic (row order matters), so it is assigned once, written, and reused. Frames over it are evaluated
in chunks of neighbouring indices with a halo, so no window needs all rows in one task.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1 << 18


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; it goes when the JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="driftspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/driftspark-{uuid.uuid4().hex}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in scratch space: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_index(df: DataFrame, *order: str | Column, name: str = "tx_index") -> DataFrame:
    """Adds a dense 0-based index in the given total order: a range partitioning, a count of each partition (the only
    thing that comes to the driver) and the row's place in its partition. Ties need further order columns."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "index")
    part = F.shiftright("_row", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    start, total = [], 0
    for p, n in sizes:
        start.append((p, total))
        total += n
    # one row a partition: the driver has just held it, and a hash lookup finds a row's offset
    offsets = df.sparkSession.createDataFrame(start, "_part long, _start long")
    found = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn(name, F.col("_start") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row", "_part", "_start")


def with_halo(df: DataFrame, before: int, after: int, index: str = "tx_index", chunk: int = CHUNK) -> DataFrame:
    """Adds ``_chunk`` and ``_own``: every row belongs to one chunk of indices and is copied to the chunks whose rows
    have it in a frame of ``before`` rows back to ``after`` rows ahead. Aggregate by ``_chunk``, then keep ``_own``."""
    chunk = max(chunk, before + after + 1)
    i = F.col(index)
    low, high = F.floor((i - after) / chunk), F.floor((i + before) / chunk)
    copies = df.withColumn("_chunk", F.explode(F.sequence(low, high)))
    return copies.withColumn("_own", F.col("_chunk") == F.floor(i / chunk))


def over_rows(df: DataFrame, before: int, after: int, columns: dict, *by: str, index: str = "tx_index") -> DataFrame:
    """Window aggregates over the frame of index values [i - before, i + after], within ``by`` if given.

    ``columns`` maps names to aggregate columns. Negative bounds exclude the current row, as in [-H, -1]."""
    w = Window.partitionBy("_chunk", *by).orderBy(index).rangeBetween(-before, after)
    spread = with_halo(df, max(before, 0), max(after, 0), index)
    return spread.select("*", *(c.over(w).alias(n) for n, c in columns.items())).where("_own").drop("_chunk", "_own")


def strided(df: DataFrame, window: int, stride: int, n: int, index: str = "tx_index", name: str = "k") -> DataFrame:
    """Copies each row i to every window k that covers it: windows end (exclusively) at window + k * stride, up to n."""
    last = (n - window) // stride
    i = F.col(index)
    low = F.greatest(F.lit(0), F.ceil((i + 1 - window) / stride)).cast("long")
    high = F.least(F.lit(last), F.floor(i / stride)).cast("long")
    return df.where((low <= high) & (F.lit(last) >= 0)).withColumn(name, F.explode(F.sequence(low, high)))


def prefixes(df: DataFrame, step: int, n: int, index: str = "tx_index", name: str = "k") -> DataFrame:
    """Copies each row to every expanding prefix k = 1.. of k * step rows that holds it."""
    last = n // step
    low = F.floor(F.col(index) / step).cast("long") + 1
    return df.where(low <= last).withColumn(name, F.explode(F.sequence(low, F.lit(last).cast("long"))))
