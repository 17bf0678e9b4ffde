"""Further columns that are named like what the operators use or return."""

import pytest
from pyspark.sql import functions as F

from driftspark.llm import decontaminate, jaccard_join, language_id, phrase_dedup

NAMES = ["n", "component", "n_shingles", "component_id", "node", "n_words", "removed", "passages", "key", "n_removed", "lang_pred", "score", "spans", "items", "kept_0", "a b", "low"]


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, text + " more"), (4, None), (None, "one two"), (5, "")]
    return spark.createDataFrame([(d, t, "en", *(f"{c}{d}" for c in NAMES)) for d, t in rows], ["doc_id", "text", "lang", *NAMES])


def check(found, results, n=6):
    rows = found.collect()
    assert len(rows) == n and len(set(found.columns)) == len(found.columns)
    for r in rows:
        assert all(r[f"own_{c}" if c in results else c] == f"{c}{r['doc_id']}" for c in NAMES)


def test_near_duplicates(docs):
    found = jaccard_join.near_duplicates(docs, kept=NAMES)
    check(found, ["n_shingles", "component_id"])
    assert {r["doc_id"]: r["component_id"] for r in found.collect()}[3] == 1


def test_passages(docs):
    found = phrase_dedup.repeated_spans(docs, kept=NAMES)
    check(found, ["n_words", "removed"])
    assert {r["doc_id"]: r["removed"] for r in found.collect()}[3] == [0, 80]
    check(phrase_dedup.remaining_texts(docs, kept=NAMES), ["n_removed"])


def test_languages(docs):
    check(language_id.predict(docs, language_id.train(docs, F.col("doc_id").isNotNull()), *NAMES), ["lang_pred", "score"])


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9", 3)], "item_id long, text string, n_words int")
    check(decontaminate.contamination(docs, bench, kept=NAMES), ["n_words", "spans", "items"])
