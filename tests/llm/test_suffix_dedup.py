import random

import numpy as np
import pytest
from tests.llm import brute

from driftspark.llm import phrase_dedup, queries, suffix_dedup
from driftspark.llm.induced_sort import Queue, Sorter


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("memory", [1 << 20, 7])
def test_suffix_array_and_common_prefixes(memory):
    rnd = random.Random(3)
    texts = [b"", b"a", b"aaaaaaaaaa", b"abababab", b"mississippi", b"banana" * 9, bytes(range(256)) * 2]
    texts += [bytes(rnd.choices(b"ab", k=rnd.randint(1, 300))) for _ in range(60)]
    texts += [bytes(rnd.choices(b"abcdefgh", k=3000)) * 2 for _ in range(3)]
    for t in texts:
        order, common = Sorter(np.frombuffer(t, np.uint8), memory=memory).sort()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert order.tolist() == want, t
        for k in range(1, len(t)):
            a, b = t[want[k - 1] :], t[want[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[k] == n


def test_queue_spills(tmp_path):
    q = Queue(str(tmp_path), "q", 10)
    for i in range(0, 40, 5):
        q.push(np.arange(i, i + 5, dtype=np.int32))
    assert q.drain().tolist() == list(range(40)) and not list(tmp_path.iterdir()) and not len(q.drain())


def test_matches_brute_force(spark):
    rnd = random.Random(7)
    parts = ["".join(rnd.choices("abc dé", k=rnd.randint(60, 260))) for _ in range(8)]
    docs = []
    for d in range(70):
        docs.append((d * 2, "".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choices("xyz é", k=rnd.randint(1, 90))) for _ in range(rnd.randint(0, 5)))))
    docs += [(500, "ab" * 300), (501, "a" * 700), (502, "a" * 99), (503, "a" * 100), (504, None), (505, ""), (506, "ba" * 200)]
    docs += [(600, parts[0]), (601, parts[0]), (602, "é" * 3000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int").repartition(5)
    old = suffix_dedup.BUFFER, suffix_dedup.SORT_BYTES
    suffix_dedup.BUFFER, suffix_dedup.SORT_BYTES = 500, 2000
    try:
        got = rows(suffix_dedup.digest_documents(df))
    finally:
        suffix_dedup.BUFFER, suffix_dedup.SORT_BYTES = old
    assert got == sorted(brute.repeated_bytes(docs), key=str)
    assert sum(x[2] > 0 for x in got) > 20


@pytest.mark.parametrize("sampled", [False, True])
def test_frequent_anchor_with_many_contexts(spark, sampled, monkeypatch):
    rnd = random.Random(5)
    shared = "".join(rnd.choices("klmnop", k=70))
    docs = []
    for d in range(90):
        left, right = ("".join(rnd.choices("ab", k=rnd.randint(0, 9))) + "qrs"[rnd.randint(0, 2)] * 40 for _ in range(2))
        docs.append((d, (left + shared + right[::-1]) * rnd.randint(1, 2)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    seen = []
    whole = suffix_dedup._ask_strings
    monkeypatch.setattr(suffix_dedup, "_ask_strings", lambda *a: seen.append(1) or whole(*a))
    monkeypatch.setattr(suffix_dedup, "BUFFER", 500)
    if sampled:
        one = suffix_dedup.hot_anchors
        monkeypatch.setattr(phrase_dedup, "HOT_LEAST", 20)
        monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda docs, of: one(docs, of, 1))
    got = rows(suffix_dedup.digest_documents(df, most=4096 if sampled else 5))
    assert seen and got == sorted(brute.repeated_bytes(docs), key=str)
    assert 20 < sum(x[2] > 0 for x in got)


def test_equal_rows_are_one(spark):
    text = "".join(random.Random(2).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(3, text), (3, text), (4, text), (4, text)], "doc_id long, text string")
    got = rows(suffix_dedup.repeated_spans(df).select("doc_id", "removed"))
    assert got == [(3, []), (3, []), (4, [0, 300]), (4, [0, 300])]


def test_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    docs = [(None, text), (3, "x" + text), (4, None), (4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["removed"] for r in suffix_dedup.repeated_spans(df).collect()}
    assert got == {(None, text): [0, 150], (3, "x" + text): [], (4, None): [], (4, ""): []}
    assert suffix_dedup.digest_documents(df.where("false")).count() == 0


def test_fixture(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op7_suffix_dedup(spark, d)) == sorted(brute.repeated_bytes(docs), key=str)
