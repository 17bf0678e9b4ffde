"""Decontamination, license scan and BPE against plain versions, with nulls, empty and long texts."""

import pytest
from tests.llm import brute

from driftspark.llm import bpe, decontaminate, license_scan, queries

DOCS = "doc_id long, text string, lang string, spans string, items int"


@pytest.fixture(scope="module")
def docs(spark):
    bench = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, f"x {bench} y {bench.upper()}!"),
        (2, None),
        (3, ""),
        (4, "Tiny item. tiny, ITEM"),
        (5, "one two three four five six seven eight nine"),
        (6, "MIT License apache license GENERAL public-license mit license"),
        (7, "Released under the MIT License. " * 3),
        (8, "word " * 60000 + bench),
        (8, "word " * 60000 + bench),
        (9, "Licensed under CC BY-NC 4.0."),
        (None, bench),
        (10, "  \n\t "),
        (11, "é" * 10 + " <|endoftext|> don't STOP 123"),
    ]
    return spark.createDataFrame([(d, t, None, "x", 1) for d, t in rows], DOCS)


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def key(row):
    return tuple(str(x) for x in row)


def test_decontaminate(spark, docs):
    bench = [("7", docs.where("doc_id = 8").first()["text"][-62:]), ("10", "tiny item"), ("3", None), ("4", "")]
    table = spark.createDataFrame([(i, t, 5) for i, t in bench], "item_id string, text string, n_words int")
    found = decontaminate.contamination(docs, table)
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n"], sorted(r["items"])) for r in found.withColumn("n", decontaminate.hit_words()).collect()),
        key=key,
    )
    want = brute.decontaminate(plain(docs), bench)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, *_ in sorted(want, key=key)]
    # chunks of the benchmark, one scan each, find the same
    old, decontaminate.CHUNK_BYTES = decontaminate.CHUNK_BYTES, 64
    try:
        again = decontaminate.contamination(docs, table).select("doc_id", "n_words", decontaminate.hit_words().alias("n"))
        assert sorted(map(tuple, again.collect()), key=key) == [x[:3] for x in got]
    finally:
        decontaminate.CHUNK_BYTES = old


def test_decontaminate_on_fixture(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op4_decontaminate(spark, d).collect()))
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == sorted(brute.decontaminate(plain(spark.read.parquet(f"{d}/documents.parquet")), items))


def test_no_benchmark_and_no_documents(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(r["spans"] == [] for r in decontaminate.contamination(docs, empty).collect())
    none = docs.where("false")
    assert decontaminate.contamination(none, empty).count() == 0
    assert license_scan.scan(none).count() == 0


def test_long_items_and_many_windows(spark, monkeypatch):
    """Items longer than a piece, chunks by number of windows, repeated windows of one and of several items."""
    text = " ".join(f"w{i * i % 97}" for i in range(300))
    items = [("a", text), ("a", text), ("b", "x " + text[:200]), ("c", "w0 w1"), (None, "w4 w9"), ("d", "w0, W1"), ("e", "é ü"), ("f", None)]
    docs = [(1, text), (2, "y " + text[100:]), (3, "w0 w1 w4 w9 É ü é"), (4, None), (5, "w0-w1")]
    table = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(brute.decontaminate(docs, [(i or "", t) for i, t in items]))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    for most in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "CHUNK_WINDOWS", most)
        n, chunks = decontaminate._chunks(table, 10)
        assert (n > 5) == (most == 40) and max(len(t.split()) for c in chunks for _, t in c) <= 16
        found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), table)
        got = [(r["doc_id"], r["n_words"], r["n"], len(r["items"]), brute.sha(",".join(r["items"]))) for r in found.withColumn("n", decontaminate.hit_words()).collect()]
        assert sorted(got) == [x[:5] for x in want]


def test_windows_that_share_a_hash(monkeypatch):
    """Equal hashes of different windows are told apart by their ids."""
    monkeypatch.setattr(decontaminate, "_MULT", decontaminate.np.uint64(0))  # the hash is the last id alone
    index = decontaminate.Index([("p", b"a b z"), ("q", b"c d z"), ("r", b"c d z"), ("s", b"e")], 3)
    assert max(w.alike for w in index.windows) == 2
    ids = decontaminate.np.array([index.vocab.get(w, 0) for w in b"a b z c d z a d z e".split()])
    assert sorted(index.find(ids)) == [(0, 3, ["p"]), (3, 3, ["q", "r"]), (9, 1, ["s"])]


def test_remove_spans():
    assert decontaminate.remove_spans(b"Aa, b c! d", [1, 3]) == b"Aa, ! d"


def test_license_base(spark, docs):
    got = license_scan.scan(docs).collect()
    base = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key)
    assert base == sorted(brute.license_base(plain(docs)), key=key)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[9] == "cc-by-nc" and labels[7] == "mit" and labels[2] == "" and labels[6] == "apache,gpl,mit"
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} for r in got)


def plain_join(w):
    """All windows of a text against all templates, without filters."""
    sets = [(label, set(t.split()), set(own.split())) for label, t, own in license_scan.TEMPLATES]
    found = {}
    for k, (_, tokens, own) in enumerate(sets):
        width = min(2 * len(tokens), len(w))
        blocks = [tokens & set(w[i : i + width]) for i in range(len(w) - width + 1)]
        good = [i for i, x in enumerate(blocks) if len(x) / len(tokens) >= license_scan.THRESHOLD and own <= x]
        for a in [i for i in good if i - 1 not in good]:
            b = next(i for i in range(a, len(w)) if i + 1 not in good)
            found.setdefault(k, []).append((a, b + width, max(len(x) / len(tokens) for x in blocks[a : b + 1])))
    out = []
    for k, runs in found.items():
        wider = [r for j, more in found.items() if sets[j][0] != sets[k][0] and sets[k][1] < sets[j][1] for r in more]
        out += [(sets[k][0], k, a, b, x) for a, b, x in runs if not any(a < d and c < b for c, d, _ in wider)]
    return sorted(out)


def test_license_join_finds_all_blocks():
    """Runs of windows that meet a template, against every window of every text; copies of a notice each count."""
    import random

    random.seed(5)
    vocab = "licensed under the apache license version 2 0 cc by nc sa 4 this work is gnu general public x y z".split()
    texts = [random.choices(vocab + ["x"] * pad, k=random.randint(1, 150)) for pad in (0, 3, 12) for _ in range(100)]
    texts += [random.sample(t.split(), k=len(t.split()) - 2) * 2 for _, t, _ in license_scan.TEMPLATES for _ in range(5)]
    notice = "Released under the MIT License".lower().split()
    texts.append((notice + ["x"] * 30) * 3)
    # a mention with most words, a whole notice, and one at each end of the text
    texts.append(notice[1:] + ["x"] * 30 + notice + ["x"] * 30 + notice[1:])
    for counts in ({}, {b"the": 9, b"license": 5, b"mit": 80, b"cc": 70}):
        matcher = license_scan.Matcher(counts)
        for w in texts:
            ids = license_scan.np.array([matcher.vocab.get(x.encode(), 0) for x in w])
            assert sorted(matcher.join(ids)) == plain_join(w)
    assert [x[1] for x in matcher.join(ids)] == [0, 0, 0]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY 4.0.", "cc-by"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
        ("This text is released under the Apache license.", "apache"),
        ("Released under the MIT License.", "mit"),
        ("Released under the Motown label with a license.", ""),
        ("released under the label with a license", ""),
        ("Licensed under the city council by-law 4.0.", ""),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "apache,mit"),
        ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
        ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
    ],
)
def test_license_labels(spark, text, labels):
    got = license_scan.scan(spark.createDataFrame([(1, f"one two. {text} three", "x")], "doc_id long, text string, labels string")).first()
    assert got["labels"] == labels


def test_positional_filter_drops_lone_seeds():
    """A rare token far from the template's others is a seed of the prefix filter, but not of the positional one."""
    matcher = license_scan.Matcher({w.encode(): 5 for w in "released under the license".split()})
    w = ["mit"] + ["x"] * 40 + "released under the mit license".split() + ["x"] * 40 + ["mit"]
    ids = license_scan.np.array([matcher.vocab.get(x.encode(), 0) for x in w])
    at = license_scan.np.flatnonzero(ids)
    assert matcher.is_prefix[0][ids[at]].sum() >= 3 and 0 not in (kept := matcher.seeds(0, at, ids[at], 10)[0]) and len(w) - 1 not in kept and 44 in kept


def test_bpe_equals_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file())
    for r in bpe.encode_documents(docs, queries.tokenizer_file()).collect():
        want = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert bpe.np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_bpe_words_equal_library():
    import random

    from tokenizers import Tokenizer

    random.seed(5)
    coder, tok = bpe.Coder(bpe.Automaton(queries.tokenizer_file())), Tokenizer.from_file(queries.tokenizer_file())
    for alphabet in ("ab", "etaoinshr", "thean 's", "Σσς́éÈß中文 \x1c\x85\xa0😀İ١x9%&"):
        for _ in range(400):
            text = "".join(random.choices(alphabet, k=random.randint(0, 40)))
            want = tok.encode(text, add_special_tokens=False).ids
            assert bpe.np.frombuffer(coder.encode(text), "<u4").tolist() == want, text


def test_bpe_new_words_are_encoded_together():
    """Words that a task meets for the first time cost a fraction of what they cost one by one."""
    import random
    import time

    random.seed(6)
    coder = bpe.Coder(bpe.Automaton(queries.tokenizer_file()))
    words = list({"".join(random.choices("etaoinshrdlu", k=random.randint(4, 12))) for _ in range(30_000)})
    start = time.process_time()
    ids = coder.encode(" ".join(words))
    together = time.process_time() - start
    start = time.process_time()
    one_by_one = [t for w in words for t in coder.a.encode_word(w.encode())]
    assert bpe.np.frombuffer(ids, "<u4").tolist() == one_by_one
    assert together < 0.5 * (time.process_time() - start)


def test_bpe_full_memory_long_words_and_added_tokens_equal_library(monkeypatch):
    """What is forgotten is learned again; long words, parts and pieces of any cut and added tokens change no result."""
    import random

    from tokenizers import Tokenizer

    random.seed(7)
    for name, most in (("CACHE_WORDS", 50), ("PIECE", 300), ("PART", 100)):
        monkeypatch.setattr(bpe, name, most)
    coder, tok = bpe.Coder(bpe.Automaton(queries.tokenizer_file())), Tokenizer.from_file(queries.tokenizer_file())
    mark = next(iter(coder.a.special))
    texts: list[str | None] = [None, "", " \x1f ", mark, f"{mark.upper()} a{mark}b", "a" * 63, "b" * 64, "c" * 65, "é" * 40, "-" * 500]
    for alphabet in ("thean 's", "中文字 é\x1cΣ", "\x00\x1d'"):
        texts += ["".join(random.choices(alphabet, k=random.choice((5, 50, 150, 900)))) for _ in range(60)]
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        assert bpe.np.frombuffer(ids, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids, text
