"""Interaction audit of quality filters: how often each filter removes what, in every order in which they can be applied.

Five filters give each document a mask of failures. Per part and label class, 32 signed parity sums are aggregated: sum
``s`` counts a document as +1 or -1 by the parity of its failures within subset ``s``. The sums are a Walsh-Hadamard
transform of the mask counts, so one inverse transform (a division by 32 that leaves no rest) gives the count of every
mask, and from these the outcome of any order follows without another look at the documents. Shapley values need no
orders at all: a document with k failures is removed by each of them in 120 / k of the 120 orders.

All work is DataFrame expressions. Texts are read once and never shuffled; what travels is a digest of each.
Conditions other than E depend on the text alone, so documents are summed by text before equal texts meet: a group of
copies, however large, is a row for each part and label class when it does.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm._common import small_batches

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
#: Groups that rows without a doc_id are dealt to when they meet the labels, which they never match.
SPREAD = 1024


def text_failures(text: Column) -> Column:
    """Bits of the conditions that depend on a text (never null) alone: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda failed, value: F.when(failed, value).otherwise(0)
    return (
        bit(n < LEAST_WORDS, 1)
        + bit(100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 2)
        + bit(100 * upper > MOST_UPPER * F.length(text), 4)
        + bit(text.rlike("[#$%&*|]"), 8)
    )


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask (of A to D), n (documents without E), n_copies (with E): a row for each kind of document
    and text.

    A document fails E if a document with a smaller doc_id has the same text; rows that share a doc_id do not precede
    each other, and one without a doc_id neither precedes nor follows. Texts are compared by SHA-256."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("same"),
        text_failures(text).alias("mask"),
    )
    rows = rows.groupBy("id", "part", "same", "mask").agg(F.count("*").alias("n"))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("same"), F.lit(SPREAD))).otherwise(-1)
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(-1).cast("long")), ["id", "spread"], "left")
    kinds = ["part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    texts = rows.groupBy("same", "mask", *kinds).agg(
        F.min("id").alias("first"),
        F.coalesce(F.min_by(F.when(F.col("id").isNotNull(), F.col("n")), "id"), F.lit(0)).alias("n_first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_without"),
        F.sum("n").alias("n_all"),
    )
    leads = F.col("first") == F.min("first").over(Window.partitionBy("same"))
    n = F.col("n_without") + F.when(leads, F.col("n_first")).otherwise(0)
    return texts.select("part", "good", "toxic", "mask", n.alias("n"), (F.col("n_all") - n).alias("n_copies"))


def sign(subset: int, mask: Column) -> Column:
    """+1 or -1: the parity of the failures of a mask within a subset."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(F.lit(subset))) % 2)


def parity_sums(kinds: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed parity sums of the documents of a part and label class."""
    mask = F.col("mask").cast("int")
    copies = MASKS >> 1  # the bit of E
    both = {0: F.col("n") + F.col("n_copies"), copies: F.col("n") - F.col("n_copies")}
    sums = [F.sum(sign(s & ~copies, mask) * both[s & copies]) for s in range(MASKS)]
    return kinds.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def _dot(values: Column, of) -> Column:
    """Sum of values[i] * of(i)."""
    return F.aggregate(F.transform(values, lambda v, i: v * of(i)), F.lit(0).cast("long"), lambda a, b: a + b)


def _each(of) -> Column:
    """An array over all 32 masks."""
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), of)


def mask_cells(sums: DataFrame) -> DataFrame:
    """part, all, good, toxic: documents by mask (arrays of 32), from the parity sums by the inverse transform."""
    of = lambda label: F.array(*(F.coalesce(F.sum(F.when(label, F.get("sums", F.lit(s)))), F.lit(0)) for s in range(MASKS)))
    per = sums.groupBy("part").agg(of(F.lit(True)).alias("all"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))
    parity = lambda a, b: 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)
    inverse = lambda c: _each(lambda m: F.call_function("div", _dot(F.col(c), lambda s: parity(s, m)), F.lit(MASKS)))
    return per.select("part", *(inverse(c).alias(c) for c in ("all", "good", "toxic")))


def outcomes(cells: DataFrame) -> DataFrame:
    """A row per part, order and step, from the counts by mask (see ``audit``)."""
    free = lambda c: _each(lambda p: _dot(F.col(c), lambda m: (m.bitwiseAND(p) == 0).cast("int")))
    cells = cells.select("part", "all", *(free(c).alias(f"free_{c}") for c in ("all", "good", "toxic")))
    orders = cells.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.array(*(F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substring("filter_order", i, 1)) - 1) for i in range(1, len(FILTERS) + 1)))
    steps = steps.withColumn("bits", bits)
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b))
    rows = steps.withColumn("bit", F.get("bits", F.col("step") - 1)).withColumn("before", before)
    left = lambda c, passed: F.get(f"free_{c}", passed)
    after = F.col("before").bitwiseOR(F.col("bit"))
    removed = lambda c: left(c, F.col("before")) - left(c, after)
    # 120 / failures is whole for one to five of them; mask 0 is in no filter
    share = _dot(F.col("all"), lambda m: F.when(m.bitwiseAND(F.col("bit")) != 0, F.lit(len(ORDERS)) / F.nullif(F.bit_count(m), F.lit(0))).otherwise(0).cast("long"))
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        left("all", after).alias("kept"),
        removed("all").alias("removed"),
        (left("all", F.lit(0)) - left("all", F.col("bit")) - removed("all")).alias("redundant"),
        F.get("all", F.col("bit")).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each
    part (value of lang), each of the 120 orders and each step.

    Defined results: a null text is the empty one; a null lang is the part ''; a document is good (toxic) if any row of
    its doc_id in ``labels`` says quality (toxic) 1, and neither without a doc_id; rows that share a doc_id are documents
    of their own; repeated texts see ``masks``; texts of any length are judged whole; further columns, whatever their
    names, are not read; without documents there is no part and no row."""
    small_batches(docs.sparkSession)
    return outcomes(mask_cells(parity_sums(masks(docs, labels))))
