"""Dataset registry, CSV scans with required columns, file inventory, fingerprints, and table sinks."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from fnmatch import fnmatch
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.plans.layout import written


@dataclass(frozen=True)
class Dataset:
    name: str
    temporal_col: str
    target_col: str
    id_col: str | None
    default_split: str | None
    required: tuple[str, ...]


#: The datasets and the columns that each has to have.
DATASETS = {
    "ieee_cis": Dataset("ieee_cis", "TransactionDT", "isFraud", "TransactionID", "train", ("TransactionID", "TransactionDT", "TransactionAmt", "isFraud")),
    "paysim": Dataset("paysim", "step", "isFraud", None, None, ("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud")),
    "ulb": Dataset("ulb", "Time", "Class", None, None, ("Time", "Amount", "Class")),
}
#: Texts that count as missing in CSV files.
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "<NA>", "#N/A", "-nan", "-NaN")


def get_dataset_metadata(name: str) -> dict:
    if name.lower() not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    return asdict(DATASETS[name.lower()])


def listed(spark: SparkSession, root: str, times: bool = False) -> list[tuple]:
    """(path, bytes) of all files below a folder (or of a file) of any file system that Spark reads, in order of their
    paths; with the time of their last change, if asked for."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(root))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(root)
    files, out = fs.listFiles(at, True), []
    while files.hasNext():
        status = files.next()
        out.append((status.getPath().toString(), status.getLen(), *([status.getModificationTime()] if times else [])))
    return sorted(out)


def _top(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """The paths at the top of a folder, or else all of them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(root))
    base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getPath().toString().rstrip("/")
    return [p for p in paths if p.rpartition("/")[0] == base] or paths


def find(spark: SparkSession, root: str, pattern: str) -> str:
    """The file at the top of a folder, else the first one below it."""
    found = [p for p, _ in listed(spark, root) if fnmatch(p.rpartition("/")[2], pattern)]
    if not found:
        raise FileNotFoundError(f"{pattern} below {root}")
    return _top(spark, root, found)[0]


def check_columns(df: DataFrame, required: tuple[str, ...], what: str) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{what}: missing required column(s) {missing}")
    return df


def scan_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A CSV table: texts that mean missing become null; a column is LONG or DOUBLE if all its other values are."""
    return typed(spark.read.csv([str(p) for p in path] if isinstance(path, list) else str(path), header=True))


def typed(raw: DataFrame) -> DataFrame:
    """Columns of text as LONG, DOUBLE or text, with null for texts that mean missing."""
    clean = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`"))
    tests: list[Column] = []
    for i, c in enumerate(raw.columns):
        v = clean(c)
        tests += [
            F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"d{i}"),
            F.count_if(v.isNotNull() & v.try_cast("long").isNull()).alias(f"l{i}"),
        ]
    bad = raw.agg(*tests).first()
    kind = lambda i: "string" if bad[f"d{i}"] else "double" if bad[f"l{i}"] else "long"
    return raw.select(*(clean(c).try_cast(kind(i)).alias(c) for i, c in enumerate(raw.columns)))


def load_ieee_cis(spark: SparkSession, data_dir: str, split: str = "train", join_identity: bool = True) -> DataFrame:
    if split not in ("train", "test"):
        raise ValueError(f"split has to be train or test, not {split!r}")
    required = tuple(c for c in DATASETS["ieee_cis"].required if split == "train" or c != "isFraud")
    tx = check_columns(scan_csv(spark, find(spark, data_dir, f"{split}_transaction.csv")), required, "ieee_cis")
    try:
        path = find(spark, data_dir, f"{split}_identity.csv") if join_identity else None
    except FileNotFoundError:
        path = None
    return tx if path is None else left_join(tx, scan_csv(spark, path), "TransactionID")


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left equi-join; a repeated right key repeats rows, as there is no uniqueness check. Sides are sized by the planner."""
    return left.join(right, key, "left")


def load_paysim(spark: SparkSession, data_dir: str) -> DataFrame:
    sizes = {p: n for p, n in listed(spark, data_dir) if p.endswith(".csv")}
    if not sizes:
        raise FileNotFoundError(f"*.csv below {data_dir}")
    largest = max(_top(spark, data_dir, list(sizes)), key=sizes.get)
    return check_columns(scan_csv(spark, largest), DATASETS["paysim"].required, "paysim")


def load_ulb(spark: SparkSession, data_dir: str) -> DataFrame:
    return check_columns(scan_csv(spark, find(spark, data_dir, "creditcard.csv")), DATASETS["ulb"].required, "ulb")


def load_dataset(spark: SparkSession, name: str, data_dir: str, **options) -> DataFrame:
    loaders = {"ieee_cis": load_ieee_cis, "paysim": lambda s, d, **_: load_paysim(s, d), "ulb": lambda s, d, **_: load_ulb(s, d)}
    if name.lower() not in loaders:
        raise ValueError(f"unknown dataset {name!r}")
    return loaders[name.lower()](spark, data_dir, **options)


def load_all(spark: SparkSession, data_dir: str, ignore: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every CSV below a folder, by its stem."""
    names = {p: p.rpartition("/")[2] for p, _ in listed(spark, data_dir)}
    return {n[:-4]: scan_csv(spark, p) for p, n in names.items() if n.endswith(".csv") and n not in ignore}


def zip_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """archive, member, line_no (from 0), line: the lines of all members of ZIP archives whose names match a pattern.

    Archives are read by Spark from any file system it knows and inflated in its tasks, a member a stretch at a time; a
    task holds one archive as it is packed (2 GB at most, Spark's bound for a file's content) and some lines. Bytes that
    are no UTF-8 become U+FFFD; an archive that is none is an error."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    # a row a batch: archives are never held together
    archives = archives.repartition("path")

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for member in z.infolist():
                        if member.is_dir() or not fnmatch(member.filename.rpartition("/")[2], pattern):
                            continue
                        with z.open(member) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=None) as text:
                            yield from _stretches(name.as_py(), member.filename, text)

    return archives.mapInArrow(inflate, "archive string, member string, line_no long, line string")


def _stretches(archive: str, member: str, text: Iterable[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Lines in record batches of about ``most`` characters."""
    lines, size, start = [], 0, 0

    def batch() -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([member] * n), pa.array(range(start, start + n), pa.int64()), pa.array(lines)], ["archive", "member", "line_no", "line"])

    for line in text:
        lines.append(line.rstrip("\r\n"))
        size += len(line)
        if size >= most:
            yield batch()
            lines, size, start = [], 0, start + len(lines)
    if lines:
        yield batch()


def scan_zip(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """The CSV tables in ZIP archives as one table, typed as ``scan_csv`` does. The lines are written to shared storage
    first, so that nothing is inflated twice; each member has a header, and all headers are alike. A record is a line."""
    lines = written(zip_lines(spark, path, pattern), "lines")
    heads = [r["line"] for r in lines.where("line_no = 0").select("line").distinct().limit(2).collect()]
    if not heads:
        raise FileNotFoundError(f"{pattern} in {path}")
    if len(heads) > 1:
        raise ValueError(f"tables in {path} have different headers")
    names = next(csv.reader(heads))
    schema = ", ".join(f"`{c}` string" for c in names)
    return typed(lines.where("line_no > 0 and line != ''").select(F.from_csv("line", schema).alias("r")).select("r.*"))


def unzip(archive: str, folder: str) -> list[str]:
    """All members of an archive as files of the driver; ``scan_zip`` reads archives where Spark can."""
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
        return z.namelist()


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, ext, size_mb of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", ext.alias("ext"), (F.col("length") / 1e6).alias("size_mb"))


def fingerprint(df: DataFrame, ident: str, index: str = "tx_index") -> DataFrame:
    """One row: the first 16 hex digits of sha256(rows_firstId_lastId)."""
    text = F.concat_ws("_", F.count("*").cast("string"), F.min_by(ident, index).cast("string"), F.max_by(ident, index).cast("string"))
    return df.agg(F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


def save_csv(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file in a folder."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def resolve_dir(file_name: str, *roots: str) -> str:
    """The folder of the first file of a name below the first of some roots that has one."""
    for root in roots:
        if Path(root).exists() and (found := sorted(Path(root).rglob(file_name))):
            return str(found[0].parent)
    raise FileNotFoundError(f"{file_name} below {', '.join(roots)}")


def head_rows(df: DataFrame, n: int, index: str = "tx_index") -> DataFrame:
    """The first n rows by their index, which a bare limit would not be."""
    return df.where(F.col(index) < n)


def sliced_join(left: DataFrame, right: DataFrame, key: str, n: int, index: str = "tx_index") -> DataFrame:
    """The left join of the first n rows; the slice comes before the join."""
    return left_join(head_rows(left, n, index), right, key)


def save_latex(df: DataFrame, path: str, rows: int = 100) -> str:
    """A small result table (its first ``rows`` rows) as a LaTeX tabular."""
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", **{c: "\\" + c for c in "&%$#_{}"}}
    text = lambda v: "".join(special.get(c, c) for c in ("" if v is None else str(v)))
    line = lambda r: " & ".join(map(text, r)) + r" \\"
    body = [rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", line(df.columns), r"\hline", *map(line, df.limit(rows).collect()), r"\hline", r"\end{tabular}"]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text("\n".join(body) + "\n", encoding="utf-8")
    return "\n".join(body)


def save_markdown(df: DataFrame, path: str, rows: int = 100) -> str:
    """A small result table (its first ``rows`` rows) as Markdown."""
    got = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return "\n".join(lines)
