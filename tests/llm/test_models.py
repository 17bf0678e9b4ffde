"""LM scores, top-k search and language ID: brute force where a result is fixed, held-out quality where it is learned."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from driftspark.llm import kd_search, language_id, lm_score, queries

D = "/root/testdata/sf0.001"


def lm_tokens(text):
    return brute.WORD.findall((text or "").translate(brute.LOWER)) + [None]


def test_lm_base_and_counts(spark, tmp_path):
    rows = [(i, f"The cat {i % 3} sat. THE dog" if i % 4 else None, "x") for i in range(60)] + [(70, "", "y"), (None, "odd", "z")]
    rows += [(71, "word " * 9000, "z"), (71, "word " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for order in (1, 2, 3):
        got = lm_score.score_documents(df, order).collect()
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = Counter(t for d, x, _ in rows if not held(d) for t in lm_tokens(x))
        n, v = sum(c.values()), len(c)
        want = []
        for d, x, _ in rows:
            t = lm_tokens(x)
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
            want.append((str(d), held(d), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
        assert sorted((str(r[0]), *r[1:5], round(r[5], 6)) for r in got) == sorted(want)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def plain_lm(rows, deleted, order):
    """Scores by the definition: dictionaries of grams, expectation-maximisation word by word over the rounded cells."""
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    seqs = {d: ["<", *lm_tokens(x)] for d, x in rows}
    gram = lambda s, i, k: (k, *s[max(0, i - k) : i + 1])

    def count(ids):
        c = Counter(gram(seqs[d], i, k) for d in ids for i in range(1, len(seqs[d])) for k in range(order))
        return c, sum(len(seqs[d]) - 1 for d in ids), len(ids)

    def estimates(s, i, counts, n, texts):
        contexts = [n] + [texts if i == 1 else counts[gram(s, i - 1, k - 1)] for k in range(1, order)]
        return [counts[gram(s, i, k)] / c if c else 0.0 for k, c in enumerate(contexts)], contexts[-1]

    level = lambda c: 1 + int(math.log2(c)) if c else 0
    training = [d for d in seqs if not held(d)]
    all_counts = count(training)
    main = count([d for d in training if d not in deleted])
    v = sum(1 for g in all_counts[0] if g[0] == 0)
    cells = {}
    for d in deleted:
        for i in range(1, len(seqs[d])):
            p, context = estimates(seqs[d], i, *main)
            logs = [math.log2(x) if x else None for x in p]
            cells.setdefault((level(context), *(None if x is None else round(x / lm_score.STEP) for x in logs)), []).append(logs)
    learned = {}
    for b in {c[0] for c in cells}:
        mine = [([0.0 if x[0] is None else 2 ** (sum(x) / len(x)) for x in zip(*logs, strict=True)] + [1 / (v + 1)], len(logs)) for c, logs in cells.items() if c[0] == b]
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(lm_score.EM_STEPS):
            new = [0.0] * len(w)
            for p, n in mine:
                total = sum(a * x for a, x in zip(w, p, strict=True))
                new = [y + n * a * x / total for y, a, x in zip(new, w, p, strict=True)]
            w = [y / sum(n for _, n in mine) for y in new]
        learned[b] = lm_score._floored(np.array(w))
    mixture = lm_score.weights_table(learned, order)
    out = {}
    for d, s in seqs.items():
        out[d] = 0.0
        for i in range(1, len(s)):
            p, context = estimates(s, i, *all_counts)
            out[d] += math.log10(sum(a * x for a, x in zip(mixture[level(context)], [*p, 1 / (v + 1)], strict=True)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_are_those_of_brute_force(spark, tmp_path, order):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 30) % 40) if i % 9 else None) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    deleted = {r["doc_id"] for r in lm_score._parts(df).where("deleted").collect()}
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(df, order).collect()}
    want = plain_lm(rows, deleted, order)
    assert deleted and got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_lm_of_no_rows_and_of_no_training_rows(spark):
    df = spark.createDataFrame([(i, "a b c") for i in range(60)], "doc_id long, text string")
    assert lm_score.score_documents(df.where("false")).count() == 0
    got = lm_score.score_documents(df.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert got and {(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in got} == {(True, 4, 0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in got)


def test_lm_answers_to_other_keys_are_refused():
    block, other = (lm_score.Block([t], 1, 1) for t in (b"a b", b"a c"))
    answer = lambda b: [{"level": 0, "shard": 0, "n": 3, "asked": lm_score.digest(b.keys[0]), "total": lm_score.pack_counts(np.ones(3)), "deleted": None}]
    assert lm_score._counted(block, answer(block))[0][0].tolist() == [1, 1, 1]
    with pytest.raises(RuntimeError, match="another order"):
        lm_score._counted(block, answer(other))


def test_lm_beats_its_base_on_held_out_text(spark):
    got = [r for r in queries.op1_lm_score(spark, D).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_is_a_distribution():
    """Over every known word, the end and one unknown token, the mixture adds up to one in seen and unseen contexts."""
    texts = [b"a b a c", b"a b", b"c c b"] * 5
    block = lm_score.Block(texts, 4, 2)
    counts = block.counts(np.ones(len(texts)))
    n, v = int(counts[0].sum()), len(counts[0])
    p, context = lm_score._estimates(block, [c.astype(float) for c in counts], n, len(texts))
    w = lm_score.weights_table(lm_score.learn(lm_score.bucket(context), p, np.ones(len(p)), 1 / (v + 1)), 2)
    assert np.allclose(w.sum(axis=1), 1) and (w[:, -1] > 0).all() and w[0, 1] == 0
    words = [b"a", b"b", b"c"]
    for before in words:
        total = 0.0
        for after in [*words, None, b"new"]:
            asked = lm_score.Block([before if after is None else before + b" " + after], 4, 2)
            known = [dict(zip(k.tolist(), c.tolist(), strict=True)) for k, c in zip(block.keys, counts, strict=True)]
            c = [np.array([float(t.get(x, 0)) for x in k.tolist()]) for t, k in zip(known, asked.keys, strict=True)]
            q, ctx = lm_score._estimates(asked, c, n, len(texts))
            total += float(((q * w[lm_score.bucket(ctx), :-1]).sum(axis=1) + w[lm_score.bucket(ctx), -1] / (v + 1))[1])
        assert abs(total - 1) < 1e-9


def test_pack_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm_score.unpack(lm_score.pack(keys)) == keys).all()


def plain_top(rows, k=20):
    vs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vs:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vs if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_lm_blocks_are_bounded_by_bytes(spark):
    """Long texts make smaller blocks; both passes give a row the same block, whatever the batches."""
    rows = [(i, "w " * (200_000 if i % 3 else 10) if i % 11 else None) for i in range(60)]
    parts = lm_score._parts(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))
    blocks = {r["block"]: (r["n"], r["size"]) for r in lm_score._blocks(parts).groupBy("block").agg(F.count("*").alias("n"), size.alias("size")).collect()}
    assert sum(n for n, _ in blocks.values()) == 60
    assert all(n == 1 or total <= lm_score.BLOCK_BYTES for n, total in blocks.values())
    asked = {(r["block"], r["deleted"]) for r in lm_score._ask(parts, 4, 2).select("block", "deleted").collect()}
    assert asked == {(b, bool(b & 1)) for b in blocks}
    alone = {r["block"] for r in lm_score._blocks(parts.where("deleted")).collect()}
    assert alone == {b for b in blocks if b & 1}
    numbers = lm_score.Numbers()
    assert len({numbers(0, False, 0) for _ in range(lm_score.BLOCK_ROWS + 1)}) == 2
    assert len({numbers(0, True, 2 * lm_score.BLOCK_BYTES) for _ in range(3)}) == 3


def test_lm_answers_are_as_wide_as_their_counts():
    for most, width in ((0, 1), (255, 1), (256, 2), (1 << 31, 4), (1 << 40, 6)):
        counts = np.array([0, 1, most, 7], float)
        raw = lm_score.pack_counts(counts)
        assert len(raw) == 4 * width and (lm_score.unpack_counts(raw, 4) == counts).all()
    assert len(lm_score.unpack_counts(lm_score.pack_counts(np.zeros(0)), 0)) == 0
    keys = lm_score.pack(np.array([3, 5], np.uint64))
    ask = [(0, 0, 0, False, 2, keys, lm_score.pack_counts(np.array([2, 0]))), (0, 1, 0, True, 1, keys_of(5), lm_score.pack_counts(np.array([300])))]
    got = [r for b in lm_score._answer([lm_score._batch(ask, lm_score.ASK)]) for r in b.to_pylist()]
    by = {r["block"]: r for r in got}
    assert by[0]["deleted"] is None and lm_score.unpack_counts(by[0]["total"], 2).tolist() == [2, 300]
    assert lm_score.unpack_counts(by[1]["deleted"], 1).tolist() == [300] and by[None]["tokens"] == 302


def keys_of(*keys):
    return lm_score.pack(np.array(keys, np.uint64))


@pytest.mark.parametrize("shard, block", [(16384, 1024), (60, 4)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # ties
    rows += [(2000, None), (2020, []), (2040, [1.0, None]), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    old = kd_search.SHARD_ROWS, kd_search.BLOCK_ROWS, kd_search.LEAF
    kd_search.SHARD_ROWS, kd_search.BLOCK_ROWS = shard, block
    try:
        got = sorted(map(tuple, kd_search.top_k(df, queries.F.col("vec_id") % 20 == 0).collect()))
    finally:
        kd_search.SHARD_ROWS, kd_search.BLOCK_ROWS, kd_search.LEAF = old
    assert got == plain_top(exact)
    assert kd_search.top_k(df.where("false"), queries.F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_on_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, queries.op3_kd_search(spark, D).collect())) == plain_top(rows)


def test_language_of_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = [r for r in queries.op8_language_id(spark, D).collect() if r["held_out"]]
    assert sum(docs[r["doc_id"]] == r["lang_pred"] for r in got) / len(got) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(spark):
    base = [(i, "the cat and the dog sat", "en") if i % 2 else (i, "der hund und die katze", "de") for i in range(40)]
    odd = [(100, None, None), (101, "", None), (102, "12 !? 3", None), (103, "the dog", None), (None, "die katze " * 9000, "de")]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df).collect()}
    assert got[100] == got[101] == got[102] == "und" and got[103] == "en" and got[None] == "de"
    assert {r["lang_pred"] for r in language_id.identify(df.drop("lang").withColumn("lang", queries.F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(df.where("false")).count() == 0


def test_code_switched_words():
    model = language_id.Model([("the cat and the dog sat on the mat", "en"), ("der hund und die katze sind auf der matte", "de")] * 4)
    p = model.label_words.__self__
    words = language_id.split("the cat sat on the mat und die katze sind auf der matte")
    got = [model.labels[i] for i in p.label_words([words])[0].argmax(axis=1)]
    assert got == ["en"] * 6 + ["de"] * 7


def test_rows_are_the_features():
    """The places found by numbers of letters are those of the features by name, the bias last."""
    model = language_id.Model([("the cat a étude sat on the mat the", "en"), ("der hund und die katze der 𐐨𐐩 𐐨𐐩", "de")] * 3)
    words = ["the", "cat", "a", "ab", "étude", "katzen", "𐐨𐐩", "𐐨", "zzzz", "der"]
    at, count = model._rows(words)
    for w, part in zip(words, language_id.np.split(at, language_id.np.cumsum(count)[:-1]), strict=True):
        want = [model.index[f] for f in language_id.features(w, model.lexicon) if f in model.index]
        assert sorted(part[:-1].tolist()) == sorted(want) and part[-1] == len(model.index)


def test_forward_backward_is_exact():
    import itertools

    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 2])
    emit, step, start = rng.random((7, 3)), rng.random((3, 3)), rng.random(3)
    long = np.array([2000, 3])  # messages stay finite
    assert np.isfinite(language_id.marginals(*language_id.messages(rng.random((2003, 3)) * 1e-9, long, step, start))).all()
    got = language_id.marginals(*language_id.messages(emit, sizes, step, start))
    at = 0
    for n in sizes.tolist():
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = start[path[0]] * math.prod(emit[at + i, y] for i, y in enumerate(path)) * math.prod(step[a, b] for a, b in itertools.pairwise(path))
            for i, y in enumerate(path):
                want[i, y] += w
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_large_components_are_exact(spark):
    """Vectors beyond what doubles or longs can multiply take part; a score beyond a long is the nearest long."""
    rows = [(0, [1.0, 1.0]), (1, [3e6, 0.0]), (2, [1.0, 0.0]), (3, [-3e6, 5.0]), (20, [2.5e15, -1.0]), (21, [2.5e15, 2.0]), (40, [1e300, 1.0]), (41, [1e300, 2.0])]
    rows += [(50, [1.0, None]), (51, [float("nan"), 1.0]), (52, [float("inf"), 1.0]), (53, None), (54, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    low, high = -(2**63), 2**63 - 1
    clip = lambda x: max(low, min(high, x))
    whole = {i: [clip(math.floor(c * 64)) for c in v] for i, v in rows[:8]}
    want = []
    for q in (0, 20, 40):
        score = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(score[:20], 1)]
    for shard in (16384, 3):
        old, kd_search.SHARD_ROWS = kd_search.SHARD_ROWS, shard
        try:
            got = sorted(map(tuple, kd_search.top_k(df, queries.F.col("vec_id") % 20 == 0).collect()))
        finally:
            kd_search.SHARD_ROWS = old
        assert got == want


def test_letters_and_languages(spark):
    """A text without a letter is und; every language that occurs is learned; a long text does not end a sample."""
    assert language_id.split("½ ² Ⅷ 12 _") == [] and language_id.split("x²y Ⅷa é") == ["x", "y", "a", "é"]
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 5, f"l{i % 90}") for i in range(900)]
    rows += [(1000 + i, "long " * 100_000, "l0") for i in range(5)] + [(2000, "½ ²", None), (2001, None, "l1"), (2002, "", "l2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "'y' as lang_pred", "1 as place")
    model = language_id.train(df, queries.F.lit(True))
    assert len(model.labels) == 90
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()}
    assert len(got) == len(rows) and all(got[i] == ("und", 0.0) for i in (2000, 2001, 2002))
    assert language_id.identify(df.where("false")).count() == 0
