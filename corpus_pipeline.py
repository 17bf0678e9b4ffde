"""A training-data pipeline over ``documents``: each stage applies one operator and its decisions take effect.

Every stage gets what its predecessor kept, written as a table, and all but the last return the columns of documents.
A decision is on its row, never joined back by doc_id, which may be null or repeated.
Part of the optional ``driftspark.llm`` operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import bpe, decontaminate, jaccard_join, language_id, phrase_dedup, queries
from driftspark.llm._common import cut, give_back, read

#: A document is rejected only if no language is found or the words hardly agree on one.
LEAST_SCORE = 0.3
#: Not expressible in SQL: the first stage is a learned model and the last one a tokenizer.
ORACLE_SQL: str | None = None


def _kept(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """doc_id, text and the other columns of docs, these under names that no operator uses for its own."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    quoted = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *quoted), names


def _like(docs: DataFrame, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows with the columns of docs, in their order and under their own names."""
    of = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType)}
    return rows.select(*(of.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; learned from the stage's own input, as the query is.

    Defined results: a row is judged by its text alone; a null, empty or letterless text goes; repeated rows and rows
    without a doc_id share one decision; further columns stay, whatever their names; an empty table stays empty."""
    model = language_id.train(docs, ~language_id.held_out())
    rows, names = _kept(docs)
    found = language_id.predict(rows, model, "text", *names.values())
    return _like(docs, found.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, the one with the smallest doc_id (null: the largest).

    Defined results: the join works on row numbers, so rows without a doc_id and rows that share one are compared like
    all others. Rows without words are in no group; those that share a doc_id are kept once. Further columns stay."""
    rows, names = _kept(docs)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    nodes = rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("id"))
    found = jaccard_join.near_duplicates(nodes, kept=("id",))
    wordless = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = F.struct(wordless.alias("wordless"), F.when(wordless, F.col("id")).otherwise(F.col("component_id")).alias("of"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("doc_id").alias("row"))
    first = found.groupBy(group.alias("group")).agg(F.min(rank)["row"].alias("row"))
    return _like(docs, rows.join(first, "row", "left_semi"), names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that a document with a smaller doc_id has; drops a document that has no others.

    Defined results: rows that share a doc_id are one document's rows; a null doc_id is the largest; a null text stays,
    an empty one goes; an untouched text stays as it is, another one keeps its words joined by one space and n_chars is
    its new length; further columns stay."""
    rows, names = _kept(docs)
    out = phrase_dedup.remaining_texts(rows, kept=list(names.values())).where("text is null or text != ''")
    if own := names.get("n_chars"):
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(own, F.when(F.col("n_removed") > 0, length).otherwise(F.col(own)))
    return _like(docs, out, names)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage.

    Defined results: each row is judged by its text; a null or wordless text is clean; further columns stay."""
    rows, names = _kept(docs)
    found = decontaminate.contamination(rows, read(spark, sf_dir, "benchmark"), kept=list(names.values()))
    return _like(docs, found.where(F.size("spans") == 0), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that are left."""
    return bpe.digest_documents(docs, queries.tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """The stage, with the executors' free heap given back before it and before the rows that it returns are made."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        out = stage(spark, docs, sf_dir)
        give_back(spark)
        return out

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _apart(language)),
    ("jaccard_join", _apart(near_duplicates)),
    ("phrase_dedup", _apart(repeated_passages)),
    ("decontaminate", _apart(benchmark_passages)),
    ("bpe", _apart(tokens)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
