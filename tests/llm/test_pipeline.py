"""The pipeline on a small fixture: each stage against what a plain version of its decision keeps."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from tests.llm import brute

import corpus_pipeline as P
from driftspark.llm._common import cut

D = "/root/testdata/sf0.001"


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark):
    columns = spark.read.parquet(f"{D}/documents.parquet").columns
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [name for name, _ in P.STAGES]
    assert names == ["language_id", "jaccard_join", "phrase_dedup", "decontaminate", "bpe"]
    for name, stage in P.STAGES:
        before = texts(docs)
        docs = cut(stage(spark, docs, D), name)
        rows = sorted(before.items())
        if name == "language_id":
            assert len(texts(docs)) >= 0.99 * len(before)
        elif name == "jaccard_join":
            assert set(texts(docs)) == {d for d, _, c in brute.jaccard_components(rows) if c == d}
        elif name == "phrase_dedup":
            left = {d: (n, gone) for d, n, gone, _ in brute.repeated_words(rows)}
            assert set(texts(docs)) == {d for d, (n, gone) in left.items() if n > gone or not gone and before[d]}
            assert all(t == before[d] for d, t in texts(docs).items() if not left[d][1])
            kept = {d: sha for d, _, gone, sha in brute.repeated_words(rows) if gone}
            assert all(brute.sha(t) == kept[d] for d, t in texts(docs).items() if d in kept)
        elif name == "decontaminate":
            assert set(texts(docs)) == {x[0] for x in brute.decontaminate(rows, items) if not x[5]}
        else:
            assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            assert {r["doc_id"] for r in docs.collect()} == set(before)
        if name != "bpe":
            assert docs.columns == columns


def test_null_and_repeated_doc_ids(spark, tmp_path):
    """Each row has its own decision and its own text, whether or not its doc_id is null or shared."""
    word = lambda c, n: [f"{c}{i}" for i in range(n)]
    one, two, three, four, five, six = (" ".join(word(c, 120)) for c in "abcdef")
    leak = "benchmark words that no training document may hold at all"
    rows = [(1, one), (1, one), (2, two), (2, three), (None, three + " end"), (None, four), (None, four), (None, five)]
    rows += [(None, f"{two} {six}"), (7, leak), (7, "clean row of a shared id"), (None, leak + " yet a longer row than that one is"), (9, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "s", t and len(t)) for d, t in rows], columns)
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    once = [(1, one), (2, two), (2, three), (None, four), (None, five), (None, f"{two} {six}"), *rows[-4:]]
    kept = cut(P.near_duplicates(spark, docs, D), "kept")
    assert plain(kept) == sorted(once, key=str)
    blank = spark.createDataFrame([(3, "", "en", "s", 0)] * 2 + [(4, None, "en", "s", None)] * 2, columns)
    assert plain(P.near_duplicates(spark, blank, D)) == [(3, ""), (4, None)]

    alone = cut(P.repeated_passages(spark, kept, D), "alone")
    want = [(d, six if t == f"{two} {six}" else t) for d, t in once]
    assert plain(alone) == sorted(want, key=str)
    assert alone.where("n_chars is distinct from length(text)").count() == 0 and alone.columns == docs.columns

    bench = spark.createDataFrame([("1", leak)], "item_id string, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.benchmark_passages(spark, alone, str(tmp_path))
    assert plain(clean) == sorted([x for x in want if leak not in (x[1] or "")], key=str) and clean.columns == docs.columns


def test_clashing_columns_and_empty_table(spark, tmp_path):
    """Further columns whose names the operators use themselves stay as they are; an empty table stays empty."""
    extra = ["score", "lang_pred", "_text", "row", "_row", "id", "removed", "spans", "items", "n_words", "kept_0", "own_3", "passages", "key", "a.b"]
    docs = spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in extra))
    docs = cut(docs, "docs")
    for name, stage in P.STAGES:
        out = cut(stage(spark, docs, D), name)
        empty = stage(spark, docs.where("doc_id < 0"), D)
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "bpe":
            assert out.columns == docs.columns and out.count()
            assert all(r[c] == f"{c} {r['doc_id']}" for r in out.collect() for c in extra)
            docs = out


def test_whole_texts(spark):
    """A very long text goes through every stage whole, and a changed text is exactly what is left of it."""
    long = " ".join(f"the{i % 9973} and of to in water{i}" for i in range(40_000))
    passage = " ".join(f"common{i} the of and" for i in range(30))
    rows = [(1, f"the first of the texts {passage} ends here"), (2, f"{long}  {passage}\nand the last words of it"), (3, "the end of it and of all")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = texts(P.repeated_passages(spark, docs, D))
    left = {d: kept for d, _, gone, kept in brute.repeated_words(rows) if gone}
    assert set(left) == {2} and brute.sha(out[2]) == left[2] and out[1] == rows[0][1] and out[3] == rows[2][1]


def test_stages_give_heap_back(spark):
    """A stage neither starts nor makes its rows with the heap that earlier steps took (here driver and executor are one JVM)."""
    vm = spark.sparkContext._jvm
    heap = lambda: vm.java.lang.Runtime.getRuntime().totalMemory() >> 20
    grown = []

    def grow():
        rows = spark.range(0, 1_200_000, 1, 4).select(F.collect_list(F.concat(F.lit("x" * 200), F.col("id"))).over(Window.partitionBy(F.col("id") % 4)).alias("l"))
        rows.limit(1).select(F.size("l")).collect()
        grown.append(heap())

    def stage(spark, docs, sf_dir):
        grown.append(heap())
        grow()
        return docs

    grow()
    P._apart(stage)(spark, spark.range(1), D)
    before, at_start, inside = grown
    assert at_start < before and heap() < inside
    assert all(hasattr(f, "__wrapped__") for _, f in P.STAGES)


def test_driver_returns_what_is_free(spark):
    """A heap of over three times what is in use stayed with the driver after every table that a stage writes."""
    context = spark.sparkContext
    runtime = context._jvm.java.lang.Runtime.getRuntime()
    size = max(64 << 20, runtime.totalMemory() - runtime.freeMemory())
    held = [context._gateway.new_array(context._jvm.long, size // 8) for _ in range(4)]
    assert len(held[0]) == size // 8
    del held
    kept = cut(spark.range(1000).toDF("doc_id"), "kept")
    total = runtime.totalMemory()
    assert total < 1.7 * (total - runtime.freeMemory())
    assert kept.count() == 1000
