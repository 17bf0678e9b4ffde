"""Quality rules over documents: fixed base rules, then robust multivariate outliers per language and source.

Four statistics of a text are transformed so that clean prose is about normal in them: the log of the mean word length,
and square roots of the shares of symbols, of repeated lines and of words in repeated windows. A regularised minimum
covariance determinant is estimated for every (lang, source) from all documents that pass the base rules; a document is
rejected if its squared Mahalanobis distance is beyond a quantile of the chi-squared distribution.

The estimate runs over all rows, in concentration steps: distances under the last estimate, the share ``SUBSET`` of a
group with the smallest ones, mean and covariance of these. A step is one scan of the table of vectors with a map-side
sum: rows are summed by (group, bin of distance), so that a group of any size sends a row per bin and task, and whole
bins are taken until they hold the share (rows of equal distance are never told apart). Two starts are carried, medians
with median deviations and the moments of all rows; the lower determinant wins. Vectors are whole multiples of 1 / GRID,
so that sums are exact and no result depends on the order or the partitions of the rows.

Groups of fewer than ``LEAST`` documents are pooled within their language; a pool that is still smaller rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, gamma, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm._common import cut, map_batches, pieces

WINDOW = 3
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a group whose covariance has the least determinant, and concentration steps towards it.
SUBSET, STEPS = 0.75, 6
#: Documents that a group needs for an estimate of its own.
LEAST = 50
#: Spread of each statistic that is always allowed for; without it, statistics that are mostly 0 have no covariance.
FLOOR = 0.1
#: Share of a normal population within the reweighted estimate, and share that lies beyond the cut-off.
REWEIGHT, BEYOND = 0.975, 1e-6
#: Lines and words that are added to those of a text when shares are taken: one repeated line of a short text is not half of it.
PRIOR_LINES, PRIOR_WORDS = 10, 100
#: Steps of the statistics in a unit, and bins of squared distances in an octave.
GRID, BINS = 512, 32
#: Bytes of text that are counted at once (a longer text alone).
PIECE = 1 << 19
#: Groups whose estimates (some 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000

STATISTICS = ("word_length", "symbols", "duplicate_lines", "repeated_words")
D = len(STATISTICS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
GROUP = ["lang", "source", "pooled"]

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# --- statistics of texts ----------------------------------------------------------------------------------------


def _dense(keys) -> tuple[np.ndarray, pa.Array]:
    """Numbers of equal keys (from 0, by first occurrence), and the keys by number."""
    found = (keys if isinstance(keys, pa.Array) else pa.array(keys)).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _slices(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pieces of data that begin at the starts."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an array (null: empty), all texts at once; exact, by comparing words and lines."""
    rows = len(texts)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    out = dict.fromkeys(COUNTS, np.zeros(rows, np.int64))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    if not rows or offsets[0] == offsets[-1]:
        return out
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    of = lambda at: np.searchsorted(offsets, at, "right") - 1  # noqa: E731  the text of a byte
    per = lambda docs: np.bincount(docs, minlength=rows)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = inside[begin]
    word_at = np.flatnonzero(first)
    if not len(word_at):
        return out
    doc = of(word_at)
    out["n_words"] = per(doc)
    chars = np.append(0, np.cumsum(inside & ((data & 0xC0) != 0x80), dtype=np.int64))
    out["word_chars"] = chars[offsets[1:]] - chars[offsets[:-1]]
    del chars, first
    out["n_symbols"] = per(of(np.flatnonzero(_SYMBOL[data])))

    breaks = np.flatnonzero(data == 10)
    line_at = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    worded = np.unique(np.searchsorted(line_at, word_at, "right") - 1)
    line_doc = of(line_at[worded])
    lines = _slices(data[data != 10], line_at - np.searchsorted(breaks, line_at))
    kind, kinds = _dense(lines.take(pa.array(worded)))
    _, distinct = _dense(line_doc * len(kinds) + kind)
    out["n_lines"] = per(line_doc)
    out["n_dup_lines"] = out["n_lines"] - per(distinct.to_numpy() // len(kinds))
    del lines

    starts = (np.cumsum(inside, dtype=np.int64) - 1)[word_at]
    word, words = _dense(_slices(data[inside], starts))
    if len(word) >= WINDOW:
        key = doc * len(words) + word
        for k in range(1, WINDOW):
            if int(key.max()) >= (1 << 62) // len(words):  # numbers of the keys keep them below 2 ** 63
                key, _ = _dense(key)
            key = key[: len(word) - k] * len(words) + word[k:]
        key, _ = _dense(key)
        whole = doc[: len(key)] == doc[WINDOW - 1 :]
        again = whole & (np.bincount(key[whole], minlength=len(key))[key] > 1)
        covered = np.zeros(len(word), bool)
        for k in range(WINDOW):
            covered[k : k + len(again)] |= again
        out["n_repeat_words"] = per(doc[covered])
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source ('' for null), the counts of each text, and base_failed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP[:2]), "text")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False)
        parts = [count(b["text"][i:j]) for i, j in pieces(sizes, PIECE)]
        found = {c: np.concatenate([x[c] for x in parts]) for c in COUNTS}
        return pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(found[c], pa.int64()) for c in COUNTS)], [*b.schema.names[:3], *COUNTS])

    out = map_batches(rows, batch, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def transformed() -> list[Column]:
    """The statistics of a row with words, in steps of 1 / GRID."""
    share = lambda a, b, prior: F.sqrt(F.col(a) / F.greatest(F.col(b) + prior, F.lit(1)))
    values = (F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars", 0), share("n_dup_lines", "n_lines", PRIOR_LINES), share("n_repeat_words", "n_words", PRIOR_WORDS))
    return [F.round(v * GRID).cast("int").alias(n) for v, n in zip(values, STATISTICS, strict=True)]


# --- chi-squared ------------------------------------------------------------------------------------------------


def chi2_cdf(x: float, d: int) -> float:
    """The distribution function, by the recurrence from one or two degrees of freedom."""
    h = x / 2
    a, upper = (0.5, erfc(sqrt(h))) if d % 2 else (1.0, exp(-h))
    while a < d / 2:
        upper += h**a * exp(-h) / gamma(a + 1)
        a += 1
    return 1 - upper


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def consistency(share: float) -> float:
    """Factor on the covariance of a normal population's innermost share."""
    return share / chi2_cdf(chi2_quantile(share, D), D + 2)


# --- minimum covariance determinant -----------------------------------------------------------------------------

_MODEL = ", ".join([*(f"c{i} double" for i in range(D)), *(f"p{i}{j} double" for i, j in PAIRS), "log_det double"])


def _precision(names: list[str], frames: Iterator[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Centre, precision matrix and log determinant of the regularised covariance of each row of sums."""
    for f in frames:
        n = f["n"].to_numpy(float)
        s = f[[f"s{i}" for i in range(D)]].to_numpy(float) / n[:, None] / GRID
        cov = np.zeros((len(f), D, D))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = f[f"q{i}{j}"].to_numpy(float) / n / GRID**2 - s[:, i] * s[:, j]
        cov = factor * cov + FLOOR**2 * np.eye(D)
        inverse = np.linalg.inv(cov)
        out = f[names].copy()
        for i in range(D):
            out[f"c{i}"] = s[:, i]
        for i, j in PAIRS:
            out[f"p{i}{j}"] = inverse[:, i, j]
        out["log_det"] = np.linalg.slogdet(cov)[1]
        yield out


def _models(sums: DataFrame, names: list[str], factor: float, name: str) -> DataFrame:
    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in names)
    return cut(sums.mapInPandas(lambda frames: _precision(names, frames, factor), f"{kinds}, {_MODEL}"), name)


def _sums() -> list[Column]:
    x = lambda i: F.col(STATISTICS[i]).cast("long")
    return [F.count("*").alias("n"), *(F.sum(x(i)).alias(f"s{i}") for i in range(D)), *(F.sum(x(i) * x(j)).alias(f"q{i}{j}") for i, j in PAIRS)]


def distance() -> Column:
    """Squared Mahalanobis distance of a row's statistics under the estimate that it was joined with."""
    z = [F.col(s) / F.lit(float(GRID)) - F.col(f"c{i}") for i, s in enumerate(STATISTICS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + z[i] * z[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0)
    return F.when(total < 0, 0.0).otherwise(total)  # null without an estimate


def _medians(cells: DataFrame, name: str) -> DataFrame:
    """GROUP, i, value: lower medians of cells (GROUP, i, value, n); values are on a grid, so a group has few."""
    by = [*GROUP, "i"]
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("value"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return cells.select(*by, "value", upto.alias("upto"), total.alias("total")).where("2 * upto >= total").groupBy(*by).agg(F.min("value").alias(name))


def _start_by_medians(rows: DataFrame) -> DataFrame:
    """Medians, and squared median deviations as a diagonal covariance."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(s).alias("value")) for i, s in enumerate(STATISTICS)))).alias("x")
    cells = rows.select(*GROUP, each).groupBy(*GROUP, "x.i", "x.value").agg(F.count("*").alias("n"))
    cells = cut(cells, "cells")
    centre = _medians(cells, "centre")
    off = F.abs(F.col("value") - F.col("centre")).alias("value")
    spread = _medians(cells.join(centre, [*GROUP, "i"]).groupBy(*GROUP, "i", off).agg(F.sum("n").alias("n")), "spread")
    both = centre.join(spread, [*GROUP, "i"]).groupBy(*GROUP)
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    variance = lambda i: F.pow(at("spread", i) * (1.4826 / GRID), F.lit(2.0)) + FLOOR**2
    log_det = sum((F.ln(variance(i)) for i in range(1, D)), F.ln(variance(0)))
    return both.agg(
        *((at("centre", i) / F.lit(float(GRID))).alias(f"c{i}") for i in range(D)),
        *((1 / variance(i) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in PAIRS),
        log_det.alias("log_det"),
    ).withColumn("start", F.lit("medians"))


def estimate(rows: DataFrame, sized) -> DataFrame:
    """GROUP and the estimate of every group of rows (GROUP, STATISTICS, n_group); ``sized`` marks a table of a row a
    group for broadcasting where its size allows it."""
    key = [*GROUP, "start"]
    whole = _models(rows.groupBy(*GROUP).agg(*_sums()).withColumn("start", F.lit("moments")), key, 1.0, "moments")
    model = cut(whole.unionByName(_start_by_medians(rows)), "starts")
    bin_ = F.floor(F.log2(1 + distance()) * BINS).cast("int")
    factor = consistency(SUBSET)
    for step in range(STEPS):
        cells = rows.join(sized(model), GROUP).groupBy(*key, bin_.alias("bin")).agg(F.max("n_group").alias("n_group"), *_sums())
        below = F.sum("n").over(Window.partitionBy(*key).orderBy("bin")) - F.col("n")
        inner = cells.withColumn("below", below).where(F.col("below") < F.ceil(SUBSET * F.col("n_group")))
        names = [c for c in cells.columns if c not in {*key, "bin", "n_group"}]
        model = _models(inner.groupBy(*key).agg(*(F.sum(c).alias(c) for c in names)), key, factor, f"step{step}")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("log_det", "start"))
    best = model.withColumn("rank", rank).where("rank = 1").drop("rank", "start")
    near = rows.join(sized(best), GROUP).where(distance() <= chi2_quantile(REWEIGHT, D))
    again = _models(near.groupBy(*GROUP).agg(*_sums()), GROUP, consistency(REWEIGHT), "reweighted")
    # a group whose centre is empty of rows keeps the estimate that it has
    rest = best.join(again.select(*GROUP), GROUP, "left_anti")
    return cut(again.unionByName(rest), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of each text, base_failed, distance (squared; null without an estimate or for
    texts that fail the base rules), kept.

    Defined results: a null text has no words and fails; null languages and sources count as ''; repeated rows are
    documents of their own; an empty table gives none; texts of any length are counted whole, in memory of some 20 times
    their length; rows of equal statistics share their verdict; further columns, whatever their names, are not read."""
    rows = cut(statistics(docs).select("*", *transformed()), "statistics")
    fine = rows.where("not base_failed")
    groups = fine.groupBy("lang", "source").agg(F.count("*").alias("n_own"))
    small = F.col("n_own") < LEAST
    pooled = F.sum(F.when(small, F.col("n_own"))).over(Window.partitionBy("lang"))
    groups = cut(groups.select("lang", "source", small.alias("pooled"), F.when(small, pooled).otherwise(F.col("n_own")).alias("n_group")), "groups")
    n_groups = groups.count()
    sized = lambda table: F.broadcast(table) if n_groups <= BROADCAST_GROUPS else table
    own = rows.join(sized(groups), ["lang", "source"], "left")
    own = own.withColumn("own_source", F.col("source")).withColumn("source", F.when(F.col("pooled"), "").otherwise(F.col("source")))
    fits = own.where((~F.col("base_failed")) & (F.col("n_group") >= LEAST)).select(*GROUP, "n_group", *STATISTICS)
    model = estimate(fits, sized)
    far = F.when(~F.col("base_failed"), distance())
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - BEYOND, D), F.lit(True))
    out = own.join(sized(model), GROUP, "left").withColumn("distance", far)
    return out.select("doc_id", "lang", F.col("own_source").alias("source"), *COUNTS, "base_failed", "distance", verdict.alias("kept"))
