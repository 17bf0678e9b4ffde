import random

import numpy as np
from tests.llm import brute

from driftspark.llm import jaccard_join as jj
from driftspark.llm import phrase_dedup, queries
from driftspark.llm.components import components


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed, groups=25, copies=8):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs, d = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 9, 14, 20, 40, 80, 200]))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
            docs.append((d := d + rnd.randint(1, 3), rnd.choice([" ", "  ", "\n"]).join(w).upper()))
    rnd.shuffle(docs)
    return docs


def test_entries_meet_for_every_linked_pair():
    """The pigeonhole guarantee itself: linked sets share an entry, over many sizes and numbers of changed tokens."""
    rnd = np.random.default_rng(11)
    missed = met = 0
    for _ in range(1500):
        n = int(rnd.choice([2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 60, 150]))
        r = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = rnd.integers(0, n // 4 + 2), rnd.integers(0, n // 4 + 2)
        s = np.unique(np.concatenate([r[drop:], rnd.integers(0, 2**64, add, dtype=np.uint64)]))
        if not len(s) or len(r) == len(s) == len(np.intersect1d(r, s)) or not jj.similar(r, s, 80):
            continue
        met += 1
        h, d = jj.entries(np.concatenate([r, s]), np.array([len(r), len(s)]), 80)
        missed += not len(np.intersect1d(h[d == 0], h[d == 1]))
    assert met > 300 and not missed


def test_matches_brute_force(spark):
    docs = near_copies(1) + [(9000, None), (9001, ""), (9002, "a"), (9003, "A"), (9004, "x y"), (9005, "\t")]
    docs += [(9100 + i, " ".join(f"c{j}" for j in range(i, i + 60))) for i in range(0, 30, 2)]  # a chain of links
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int").repartition(6)
    old, jj.BUFFER, jj.SALT = (jj.BUFFER, jj.SALT), 2000, 2
    try:
        got = rows(jj.near_duplicates(df))
    finally:
        jj.BUFFER, jj.SALT = old
    assert got == sorted(brute.jaccard_components(docs), key=str)
    assert sum(c != d for d, _, c in got) > 40


def test_copies_that_differ_from_one_another(spark):
    """Copies of a centre that link to it but not to each other, the centre being neither first nor last."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(104)]
    docs = [(500, " ".join(base))]
    for i in range(60):
        w = list(base)
        for j in rnd.sample(range(5, 99), 2):
            w[j] = f"x{i}_{j}"
        docs.append((i if i % 2 else 1000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jj.near_duplicates(df)) == sorted(brute.jaccard_components(docs), key=str)


def test_rounds_of_unconnected_groups(spark, monkeypatch):
    """Members that give one partner a round, in small pieces of work, reach the same groups after several rounds."""
    base = [f"w{i}" for i in range(110)]
    docs = []
    for i, j in enumerate([*range(5, 100, 5), *range(8, 30, 5)]):  # most are 24 shingles apart, one too many
        w = list(base)
        w[j], w[-2] = f"x{i}", f"y{i}"
        docs.append((1000 - i if i % 2 else i, " ".join(w)))
    rounds, one = [], jj._across
    monkeypatch.setattr(jj, "_across", lambda *a: rounds.append(a[-1]) or one(*a))
    for name, value in (("NEAREST", 1), ("MEMBERS", 16), ("OUTLIERS", 8)):
        monkeypatch.setattr(jj, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(jj.near_duplicates(df)) == sorted(brute.jaccard_components(docs), key=str)
    assert len(rounds) > 1


def test_frequent_buckets(spark, monkeypatch):
    """Buckets that are spread over the shards by their members give the same links."""
    docs = near_copies(6, groups=6, copies=60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    one, seen = jj.hot_anchors, []
    monkeypatch.setattr(phrase_dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(jj, "hot_anchors", lambda docs, of: seen.append(one(docs, of, 1)) or seen[-1])
    monkeypatch.setattr(jj, "BUFFER", 1500)
    assert rows(jj.near_duplicates(df)) == sorted(brute.jaccard_components(docs), key=str)
    assert len(seen[0])


def test_centres_are_the_sets_that_others_resemble_most():
    """The unchanged copy is the centre, wherever it stands, and buckets make fewer pairs than with smallest ids."""
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**64, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rnd.permutation(90)[4:]], rnd.integers(0, 2**64, 4, dtype=np.uint64)])) for _ in range(40)]
    sets.insert(25, np.unique(base))
    h, d = jj.entries(np.concatenate(sets), np.array(list(map(len, sets))), 80)
    rank = jj._ranks(h, d, len(sets))
    assert rank.argmin() == 25 and (np.delete(rank, 25) > rank[25]).all()
    pairs = lambda order: len({(m[0], x) for m in (sorted(d[h == v].tolist(), key=order) for v in np.unique(h)) for x in m[1:]})
    assert pairs(lambda i: (rank[i], i)) < 0.75 * pairs(lambda i: i)


def test_odd_rows(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F")]
    got = rows(jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jj.near_duplicates(empty).count() == 0


def test_fixture(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op10_jaccard_join(spark, d)) == sorted(brute.jaccard_components(docs), key=str)


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    links += [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: r for x, r in root.items()}


def test_sketches_never_overstate_a_difference():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        n = int(rnd.integers(1, 300))
        r = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        s = np.unique(np.concatenate([r[rnd.integers(0, n) :], rnd.integers(0, 2**64, n // 5 + 1, dtype=np.uint64)]))
        assert jj.differing(jj.sketch(r), jj.sketch(s)) <= len(np.setxor1d(r, s))
        assert len(jj.sketch(r)) == jj.sketch_bytes(len(r))
