"""Shared plumbing of the training-data operators: reading, Arrow batches, word splitting, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space (UTF-8 bytes stay).
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Text bytes that are held as Python words at once.
PIECE_BYTES = 1 << 21
#: Rows and bytes of the Arrow batches that travel to Python at most (a longer row is a batch of its own).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

#: Least and most per cent of the driver's heap that are free after a collection by ``tighten``.
HEAP_RATIOS = (("MinHeapFreeRatio", "10"), ("MaxHeapFreeRatio", "30"))


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that a worker's memory does not follow the length of the rows."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_ALNUM).split()


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged."""
    return text.split()


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return text.lower().split()


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo; a null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; it goes when the JVM ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="driftspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/driftspark-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame as a table in shared scratch space and reads it again: lineage ends here and lost executors lose nothing.

    Spark deletes a shuffle's files once its driver's collector finds that nothing refers to it, and its scheduler refers to
    the last job until another one runs. A job of one row and a collection release the shuffles of this step, which would
    else pile up on the executors' disks."""
    spark, schema = df.sparkSession, df.schema
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    del df
    spark.range(1).collect()
    tighten(spark)
    return spark.read.schema(schema).parquet(path)


def tighten(spark: SparkSession) -> None:
    """The driver collects its garbage and returns the memory that is then free to the system.

    A JVM keeps a heap of more than three times what is in use after a collection, and its C library keeps what compilers
    and native code have freed, so the driver would grow with the number of plans it has seen. For this one collection
    the heap's ratios are narrower; then freed native memory goes back. A JVM without these switches only collects."""
    context = spark.sparkContext
    jvm, gateway = context._jvm, context._gateway
    lang, factory = jvm.java.lang, jvm.java.lang.management.ManagementFactory

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def call(target, interface: str, name: str, *args: str):
        """A method of a public interface whose class is not open to reflection."""
        texts = [lang.Class.forName("java.lang.String")] * len(args)
        return lang.Class.forName(interface).getMethod(name, array(lang.Class, *texts)).invoke(target, array(lang.Object, *args))

    switches = "com.sun.management.HotSpotDiagnosticMXBean"
    before: list[tuple[str, str]] = []
    bean = None
    try:
        bean = factory.getPlatformMXBean(lang.Class.forName(switches))
        # the lower one first: it may never be above the other
        for name, value in HEAP_RATIOS:
            now = call(bean, switches, "getVMOption", name).getValue()
            if int(now) > int(value):
                call(bean, switches, "setVMOption", name, value)
                before.insert(0, (name, now))
    except Py4JError:
        pass
    try:
        lang.System.gc()
    finally:
        for name, now in before:
            call(bean, switches, "setVMOption", name, now)
    try:
        server, server_type = factory.getPlatformMBeanServer(), lang.Class.forName("javax.management.MBeanServer")
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds = array(lang.Class, commands.getClass(), lang.Class.forName("java.lang.String"), array(lang.Object).getClass(), array(lang.String).getClass())
        invoke = server_type.getMethod("invoke", kinds)
        invoke.invoke(server, array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JError:
        pass
    trim()


def give_back(spark: SparkSession) -> None:
    """Every executor collects its garbage and returns the heap that is then free to the system.

    A JVM keeps the heap that its busiest step made it take, so a later step that needs little of it but more for its
    Python workers would pay for both. One short task a core calls System.gc(); where that may not be called, or a JVM
    ignores it, nothing else changes. The driver does the same."""
    tighten(spark)
    n = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
    except PySparkException:
        pass


def pieces(sizes: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``most`` bytes each (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(column: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """UTF-8 bytes of each row and their lengths (null: 0)."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    values = column.to_pylist()
    return values, np.fromiter((len(v) if v is not None else 0 for v in values), np.int64, len(values))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def with_columns(schema: str, df: DataFrame, names: Sequence[str]) -> str:
    """A schema with further columns of a frame at its end."""
    return ", ".join([schema, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)])


def apart(kept: Sequence[str], *taken: str) -> tuple[list[Column], list[Column]]:
    """Further columns under names that no operator uses for its own, and these under their own names again. A column
    that is named like one of ``taken``, the operator's results, comes back as own_<name>."""
    away = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)]
    return away, [F.col(f"kept_{i}").alias(f"own_{c}" if c in taken else c) for i, c in enumerate(kept)]


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function over batches, giving freed memory back to the system after each batch it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield out
            del out
            trim()
        trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    import ctypes

    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.malloc_trim  # noqa: B018
        return lib
    except (OSError, AttributeError):
        return None


_LIBC = _libc()


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one cheap aggregate, used only to size partitions."""
    small_batches(df.sparkSession)
    return df.select(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(size: int, each: int = 8 << 20, least: int = 8) -> int:
    """A partition count that keeps about ``each`` bytes in a partition; it grows with the data."""
    return max(least, -(-size // each))
