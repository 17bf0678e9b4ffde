import random

import numpy as np
from tests.llm import brute

from driftspark.llm import phrase_dedup, queries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    parts = [[rnd.choice(vocab) for _ in range(rnd.randint(30, 90))] for _ in range(12)]
    docs = []
    for d in range(120):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text += rnd.choice(parts) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 40))]
        docs.append((d * 3, rnd.choice([" ", "\n", "\t "]).join(text)))
    docs += [(1000, "a b " * 200), (1001, "b a " * 120), (1002, "z " * 49), (1003, "z " * 50), (1004, None), (1005, "")]
    docs += [(1006, "z " * 5000), (1007, " ".join(vocab[:50])), (1008, " ".join(vocab[:50]))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n int").repartition(5)
    old, phrase_dedup.BUFFER = phrase_dedup.BUFFER, 3000
    try:
        got = rows(phrase_dedup.digest_documents(df))
    finally:
        phrase_dedup.BUFFER = old
    assert got == sorted(brute.repeated_words(docs), key=str)
    assert sum(x[2] > 0 for x in got) > 30


def test_frequent_anchor_with_many_windows(spark, monkeypatch):
    rnd = random.Random(4)
    shared = [f"k{i}" for i in range(30)]
    docs = []
    for d in range(80):
        left, right = ([f"{rnd.choice('abc')}{i}" for i in range(3)] + [f"{side}{i}" for i in range(25)] for side in rnd.choices("xyz", k=2))
        docs.append((d, " ".join([*left, *shared, *right[::-1]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    one, seen = phrase_dedup.hot_anchors, []
    monkeypatch.setattr(phrase_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(phrase_dedup, "hot_anchors", lambda docs, of: seen.append(one(docs, of, 1)) or seen[-1])
    got = rows(phrase_dedup.digest_documents(df))
    assert len(seen[0]) and got == sorted(brute.repeated_words(docs), key=str)
    assert sum(x[2] > 0 for x in got) > 20


def test_repeated_and_null_ids(spark):
    text = " ".join(f"q{i}" for i in range(60))
    docs = [(5, text), (5, text), (5, "x " + text + " y"), (None, text), (7, None), (9, "tail " + text)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["removed"] for r in phrase_dedup.repeated_spans(df).collect()}
    assert got[(5, text)] == [] and got[(5, "x " + text + " y")] == []
    assert got[(9, "tail " + text)] == [1, 61] and got[(None, text)] == [0, 60]
    assert phrase_dedup.repeated_spans(df.where("false")).count() == 0
    kept = {r["doc_id"]: r["text"] for r in phrase_dedup.remaining_texts(df).collect()}
    assert kept[9] == "tail" and kept[7] is None


def test_fixture(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op5_phrase_dedup(spark, d)) == sorted(brute.repeated_words(docs), key=str)


def test_gram_hashes_and_minimisers():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 2**63, 200).astype(np.uint64)
    for n in (1, 2, 5, 10, 50):
        g = phrase_dedup.gram_hashes(h, n, phrase_dedup._M1)
        assert len(g) == 200 - n + 1
        assert g[3] == phrase_dedup.gram_hashes(h[3 : 3 + n], n, phrase_dedup._M1)[0]
    small = rnd.integers(0, 5, 200).astype(np.uint64)
    for w in (1, 2, 7, 41):
        assert phrase_dedup.minimisers(small, w).tolist() == [i + int(np.argmin(small[i : i + w])) for i in range(200 - w + 1)]
