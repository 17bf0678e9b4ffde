"""Registry of the engine's queries and of the SQL that each is compared with.

The canonical stream is ``events``: index by (ts, event_id), segment = event_type, amount = value, k from props,
y = (value > 120), and a score with many ties. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import metrics, stats
from driftspark.operators import events, inject, prep, profile, reports
from driftspark.plans.layout import over_rows, scratch, with_index
from driftspark.plans.runs import RunTables
from driftspark.plans.scan import LAST, MAX, SUM, running
from driftspark.sources import datasets
from driftspark.sources.datasets import fingerprint, left_join
from driftspark.streaming import fold, keyed
from driftspark.streaming.grid import run_grid

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_INDEXED: dict[tuple[str, str], DataFrame] = {}

#: The canonical stream in SQL.
TX = """tx AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS tx_index, event_id AS tx_id, ts,
 event_type AS segment_key, user_id, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE WHEN value > 120 THEN 1 ELSE 0 END AS y,
 CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 + event_id % 13) % 101 AS DOUBLE) / 100 AS y_prob FROM events),
 size AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.15) AS BIGINT) AS w FROM tx)"""
WINDOW, HORIZON = 1000, 500


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql.replace("{TX}", TX)
        return fn

    return register


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("tx_id"),
        "ts",
        F.col("event_type").alias("segment_key"),
        "user_id",
        F.col("value").alias("amount"),
        k.alias("k"),
        (F.col("value") > 120).cast("int").alias("y"),
        (((k * 7 + F.col("event_id") % 13) % 101).cast("double") / 100).alias("y_prob"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical stream with its index, built once per session and state of the folder (its files, sizes and times)."""
    files = datasets.listed(spark, f"{sf_dir}/events.parquet", times=True)
    key = (spark.sparkContext.applicationId, str(files))
    if key not in _INDEXED:
        _INDEXED[key] = with_index(events_table(spark, sf_dir), "ts", "tx_id")
    return _INDEXED[key]


def sizes(df: DataFrame, fraction: float = 0.15) -> tuple[int, int]:
    n = df.count()
    return n, int(n * fraction)


def ap_sql(source: str, by: str = "", fallback: str = "NULL") -> str:
    """Average precision and friends of a CTE with (by, s, y), as further CTEs ending in one named ``ap``."""
    p = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""g AS (SELECT {g}s, sum(y) AS p, count(*) AS c FROM {source} GROUP BY {g}s),
 r AS (SELECT *, sum(p) OVER ({p} ORDER BY s DESC) AS tp, sum(c) OVER ({p} ORDER BY s DESC) AS kk, sum(p) OVER ({p}) AS pos, sum(c) OVER ({p}) AS n FROM g),
 ap AS (SELECT {g}max(n) AS n, max(pos) AS pos,
  CASE WHEN max(pos) > 0 AND max(pos) < max(n) THEN sum(CAST(p AS DOUBLE) / nullif(pos, 0) * CAST(tp AS DOUBLE) / kk) ELSE {fallback} END AS ap,
  coalesce(sum(CAST(p AS DOUBLE) / nullif(pos, 0) * CAST(tp AS DOUBLE) / kk), 0.0) AS slice_ap,
  CASE WHEN max(pos) > 0 AND max(pos) < max(n) THEN sum((c - p) * (tp - p + CAST(p AS DOUBLE) / 2)) / (max(pos) * (max(n) - max(pos))) END AS roc,
  CASE WHEN max(pos) > 0 AND max(pos) < max(n) THEN sum(CAST(p AS DOUBLE) / pos * (CAST(tp AS DOUBLE) / kk + CASE WHEN kk > c THEN CAST(tp - p AS DOUBLE) / (kk - c) ELSE 1.0 END) / 2) ELSE 0.0 END AS trap
  FROM r {"GROUP BY " + by if by else ""})"""


def six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# --- scans, order, fingerprints, joins -------------------------------------------------------------------------


@query("WITH {TX} SELECT tx_index, tx_id, segment_key, y FROM tx WHERE tx_index < 100")
def scan_index_head(spark, d):
    return stream(spark, d).where("tx_index < 100").select("tx_index", "tx_id", "segment_key", "y")


@query("WITH {TX} SELECT count(*) AS n_back FROM (SELECT ts < lag(ts) OVER (ORDER BY tx_index) AS b FROM tx) WHERE b")
def monotonic_check(spark, d):
    df = stream(spark, d)
    before = over_rows(df.select("tx_index", "ts"), 1, -1, {"before": F.max("ts")})
    return before.where("ts < before").agg(F.count("*").alias("n_back"))


@query("WITH {TX} SELECT substr(sha256(concat_ws('_', count(*), min_by(tx_id, tx_index), max_by(tx_id, tx_index))), 1, 16) AS fingerprint FROM tx")
def dataset_fingerprint(spark, d):
    return fingerprint(stream(spark, d), "tx_id")


@query("""SELECT source, count(*) AS n, count(quality) AS n_labelled, CAST(sum(toxic) AS BIGINT) AS n_toxic
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def left_join_labels(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    both = left_join(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.sum("toxic").cast("long").alias("n_toxic"))


@query("WITH {TX} SELECT CASE WHEN tx_index < w THEN 'warmup' ELSE 'stream' END AS part, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive FROM tx, size GROUP BY 1")
def warmup_split_counts(spark, d):
    df = stream(spark, d)
    _, w = sizes(df)
    part = F.when(F.col("tx_index") < w, "warmup").otherwise("stream").alias("part")
    return df.groupBy(part).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_positive"))


# --- preprocessing ----------------------------------------------------------------------------------------------


def _raw(df: DataFrame) -> DataFrame:
    return df.select("tx_index", "tx_id", "ts", F.col("segment_key").alias("type"), "amount", F.nullif(F.col("k") % 10, F.lit(0)).alias("k10"), "y")


_RAW_SQL = "raw AS (SELECT tx_index, segment_key AS type, amount, nullif(k % 10, 0) AS k10, y FROM tx), warm AS (SELECT raw.* FROM raw, size WHERE tx_index < w)"


def _prep(df: DataFrame, w: int) -> prep.Preprocessor:
    return prep.Preprocessor("paysim", "y", "ts", "tx_id").fit(df.where(F.col("tx_index") < w).drop("tx_index"))


@query("""WITH {TX}, """ + _RAW_SQL + """ SELECT 'amount' AS "column", round(median(amount), 6) AS median, round(avg(amount), 6) AS mean, round(stddev_pop(amount), 6) AS std FROM warm
 UNION ALL SELECT 'k10', round(median(CAST(k10 AS DOUBLE)), 6), round(avg(k10), 6), round(stddev_pop(k10), 6) FROM warm""")
def prep_fit_numeric(spark, d):
    df = _raw(stream(spark, d))
    _, w = sizes(df)
    return prep.fit_numeric(df.where(F.col("tx_index") < w), ["amount", "k10"]).select("column", *six("median", "mean", "std"))


@query("""WITH {TX}, """ + _RAW_SQL + """ SELECT type AS category, CAST(row_number() OVER (ORDER BY type) AS INTEGER) AS code FROM (SELECT DISTINCT type FROM warm WHERE type IS NOT NULL)""")
def prep_vocab(spark, d):
    df = _raw(stream(spark, d))
    _, w = sizes(df)
    return prep.fit_vocabulary(df.where(F.col("tx_index") < w), ["type"]).select("category", "code")


_CODE_SQL = "codes AS (SELECT type, row_number() OVER (ORDER BY type) AS code FROM (SELECT DISTINCT type FROM warm{0})), med AS (SELECT median(amount) AS ma, median(CAST(k10 AS DOUBLE)) AS mk, avg(amount) AS aa, stddev_pop(amount) AS sa, avg(k10) AS ak, stddev_pop(k10) AS sk FROM warm)"


@query("WITH {TX}, " + _RAW_SQL + ", " + _CODE_SQL.format("") + """ SELECT tx_index, CAST(coalesce(code, 0) AS INTEGER) AS type, coalesce(amount, ma) AS amount, coalesce(CAST(k10 AS DOUBLE), mk) AS k10, y, type AS segment_key
 FROM (SELECT raw.*, code, ma, mk FROM raw LEFT JOIN codes USING (type) CROSS JOIN med)""".replace("type AS segment_key", "type_ AS segment_key").replace("raw.*, code", "raw.* , raw.type AS type_, code"))
def prep_transform_impute(spark, d):
    df = _raw(stream(spark, d))
    _, w = sizes(df)
    return _prep(df, w).transform(df, "tx_index")


@query("WITH {TX}, " + _RAW_SQL + ", " + _CODE_SQL.format("") + """ SELECT tx_index, round((coalesce(amount, ma) - aa) / coalesce(nullif(sa, 0), 1), 6) AS amount, round((coalesce(CAST(k10 AS DOUBLE), mk) - ak) / coalesce(nullif(sk, 0), 1), 6) AS k10 FROM raw CROSS JOIN med""")
def prep_transform_scaled(spark, d):
    df = _raw(stream(spark, d))
    _, w = sizes(df)
    return _prep(df, w).transform(df, "tx_index", scale=True).select("tx_index", *six("amount", "k10"))


@query("WITH {TX}, " + _RAW_SQL + ", " + _CODE_SQL.format(" WHERE type <> 'view'") + " SELECT raw.type AS category, CAST(coalesce(code, 0) AS INTEGER) AS code, count(*) AS n FROM raw LEFT JOIN codes USING (type) GROUP BY 1, 2")
def prep_unseen_category(spark, d):
    df = _raw(stream(spark, d))
    _, w = sizes(df)
    p = prep.Preprocessor("paysim", "y", "ts", "tx_id").fit(df.where((F.col("tx_index") < w) & (F.col("type") != "view")).drop("tx_index"))
    out = p.transform(df, "tx_index")
    return out.groupBy(F.col("segment_key").alias("category"), F.col("type").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT 'all' AS segment_key, count(*) AS n FROM events")
def segment_default(spark, d):
    df = stream(spark, d)
    return df.groupBy(prep.segment_key(df, "ulb").alias("segment_key")).agg(F.count("*").alias("n"))


# --- metrics ----------------------------------------------------------------------------------------------------

_CONF = """SELECT {g}count(*) FILTER (WHERE h AND y = 1) AS tp, count(*) FILTER (WHERE h AND y = 0) AS fp, count(*) FILTER (WHERE NOT h AND y = 1) AS fn, count(*) FILTER (WHERE NOT h AND y = 0) AS tn FROM (SELECT *, y_prob >= 0.5 AS h FROM tx) {by}"""
_RATES = """round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(5.0 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2"""


@query("WITH {TX}, c AS (" + _CONF.format(g="", by="") + ") SELECT tp, fp, fn, tn, " + _RATES + " FROM c")
def confusion_metrics(spark, d):
    return metrics.confusion(stream(spark, d)).select("tp", "fp", "fn", "tn", *six("precision", "recall", "f1", "f2"))


@query("WITH {TX}, q AS (SELECT y_prob AS s, y FROM tx), " + ap_sql("q") + " SELECT CAST(n AS BIGINT) AS n_samples, CAST(pos AS BIGINT) AS n_positive, round(ap, 6) AS pr_auc FROM ap")
def average_precision(spark, d):
    return metrics.ranking(stream(spark, d)).select("n_samples", "n_positive", *six("pr_auc"))


@query("WITH {TX}, q AS (SELECT segment_key, y_prob AS s, y FROM tx), " + ap_sql("q", "segment_key") + " SELECT segment_key, round(roc, 6) AS roc_auc FROM ap")
def roc_auc(spark, d):
    return metrics.ranking(stream(spark, d), "segment_key").select("segment_key", *six("roc_auc"))


@query("WITH {TX}, q AS (SELECT segment_key, y_prob AS s, y FROM tx), " + ap_sql("q", "segment_key") + ", c AS (" + _CONF.format(g="segment_key, ", by="GROUP BY segment_key") + ") SELECT segment_key, CAST(n AS BIGINT) AS n_samples, CAST(pos AS BIGINT) AS n_positive, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, " + _RATES + " FROM ap JOIN c USING (segment_key)")
def metric_snapshot_by_segment(spark, d):
    out = metrics.snapshot(stream(spark, d), "segment_key")
    return out.select("segment_key", "n_samples", "n_positive", *six("pr_auc", "roc_auc", "precision", "recall", "f1", "f2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_snapshot_by_segment(spark, sf_dir)


@query("WITH {TX}, q AS (SELECT y_prob AS s, y FROM tx, size WHERE tx_index >= n - 1000), " + ap_sql("q") + " SELECT CAST(n AS BIGINT) AS n_samples, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc FROM ap")
def last_n_snapshot(spark, d):
    df = stream(spark, d)
    n, _ = sizes(df)
    return metrics.ranking(df.where(F.col("tx_index") >= n - 1000)).select("n_samples", *six("pr_auc", "roc_auc"))


@query("WITH {TX} SELECT segment_key, count(*) AS n, round(avg(k / 1000.0), 6) AS mean, round(quantile_cont(k / 1000.0, 0.5), 6) AS p50, round(quantile_cont(k / 1000.0, 0.95), 6) AS p95, round(quantile_cont(k / 1000.0, 0.99), 6) AS p99 FROM (SELECT segment_key, CAST(k AS DOUBLE) AS k FROM tx) GROUP BY segment_key")
def latency_percentiles(spark, d):
    df = stream(spark, d).withColumn("latency", F.col("k") / F.lit(1000.0))
    return metrics.latency_percentiles(df, "latency", "segment_key").select("segment_key", "n", *six("mean", "p50", "p95", "p99"))


@query("""WITH {TX}, st AS (SELECT greatest(1, n // 50) AS s, n FROM size),
 ks AS (SELECT unnest(range(0, (n - 1000) // s + 1)) AS k, s AS step FROM st),
 q AS (SELECT ks.k AS k, y_prob AS s, y FROM ks JOIN tx ON tx_index >= ks.k * step AND tx_index < ks.k * step + 1000), """ + ap_sql("q", "k") + " SELECT k, round(trap, 5) AS pr_auc, CAST(n AS BIGINT) AS n FROM ap")
def rolling_pr_auc_trajectory(spark, d):
    df = stream(spark, d)
    n, _ = sizes(df)
    return events.trajectory(df, n, WINDOW, 50, "tx_index").select("k", "pr_auc", "n")


# --- windows ----------------------------------------------------------------------------------------------------


@query("WITH {TX} SELECT tx_index, count(*) OVER w AS n_window, CAST(sum(y) OVER w AS BIGINT) AS n_fraud, round(avg(y) OVER w, 6) AS prevalence FROM tx WINDOW w AS (ORDER BY tx_index ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)")
def window_stats_global(spark, d):
    out = over_rows(stream(spark, d).select("tx_index", "y"), WINDOW - 1, 0, {"n_window": F.count("*"), "n_fraud": F.sum("y"), "prevalence": F.avg("y")})
    return out.select("tx_index", "n_window", "n_fraud", *six("prevalence"))


@query("WITH {TX} SELECT tx_index, segment_key, count(*) OVER w AS n_window, CAST(sum(y) OVER w AS BIGINT) AS n_fraud FROM tx WINDOW w AS (PARTITION BY segment_key ORDER BY tx_index RANGE BETWEEN 999 PRECEDING AND CURRENT ROW)")
def window_stats_segment(spark, d):
    df = stream(spark, d).select("tx_index", "segment_key", "y")
    return over_rows(df, WINDOW - 1, 0, {"n_window": F.count("*"), "n_fraud": F.sum("y")}, "segment_key").select("tx_index", "segment_key", "n_window", "n_fraud")


@query("WITH {TX} SELECT coalesce(nullif(segment_key, 'error'), '__none__') AS segment_key, count(*) AS n FROM tx, size WHERE tx_index >= n - 1000 GROUP BY 1")
def buffer_segment_counts(spark, d):
    df = stream(spark, d)
    n, _ = sizes(df)
    key = F.coalesce(F.nullif(F.col("segment_key"), F.lit("error")), F.lit("__none__"))
    return df.where(F.col("tx_index") >= n - WINDOW).groupBy(key.alias("segment_key")).agg(F.count("*").alias("n"))


def _triggers(df: DataFrame, w: int) -> DataFrame:
    return df.where((F.col("tx_index") >= w) & ((F.col("tx_index") - w + 1) % WINDOW == 0)).select("tx_index")


@query("WITH {TX} SELECT tx_index, CAST(row_number() OVER (ORDER BY tx_index) - 1 AS BIGINT) AS event_no FROM tx, size WHERE tx_index >= w AND (tx_index - w + 1) % 1000 = 0")
def p1_triggers(spark, d):
    df = stream(spark, d)
    _, w = sizes(df)
    return _triggers(df, w).select("tx_index", ((F.col("tx_index") - w + 1) / WINDOW - 1).cast("long").alias("event_no"))


@query("""WITH {TX}, t AS (SELECT tx_index AS trigger FROM tx, size WHERE tx_index >= w AND (tx_index - w + 1) % 1000 = 0),
 q AS (SELECT CAST(trigger AS VARCHAR) || CASE WHEN tx_index < trigger THEN 'a' ELSE 'b' END AS key, y_prob AS s, y FROM t JOIN tx ON tx_index <> trigger AND tx_index BETWEEN trigger - 500 AND trigger + 500 CROSS JOIN size WHERE tx_index >= w), """ + ap_sql("q", "key") + """
 SELECT trigger, round(a.slice_ap, 6) AS pre_ap, round(b.slice_ap, 6) AS post_ap, round(round(b.slice_ap, 6) - round(a.slice_ap, 6), 6) AS delta, CAST(coalesce(a.n, 0) AS BIGINT) AS n_pre, CAST(coalesce(b.n, 0) AS BIGINT) AS n_post, coalesce(b.n, 0) = 500 AS complete
 FROM t LEFT JOIN ap a ON a.key = CAST(trigger AS VARCHAR) || 'a' LEFT JOIN ap b ON b.key = CAST(trigger AS VARCHAR) || 'b'""")
def pre_post_horizon_ap(spark, d):
    df = stream(spark, d)
    _, w = sizes(df)
    return events.horizons(df.where(F.col("tx_index") >= w), _triggers(df, w), HORIZON)


# --- drift injection --------------------------------------------------------------------------------------------


def _drifted(spark, d, regime, **kw):
    df = stream(spark, d).withColumn("a", F.col("amount")).withColumn("b", F.col("k").cast("double"))
    _, w = sizes(df)
    cfg = inject.DriftConfig(regime, t_drift=3000, transition_width=2000, recurrence_period=1000, target_segment="view", swap_pairs=(("a", "b"),), **kw)
    return inject.inject(df, cfg, w)


_SWAPPED = "CASE WHEN {0} THEN CAST(k AS DOUBLE) ELSE amount END AS a, CASE WHEN {0} THEN amount ELSE CAST(k AS DOUBLE) END AS b"


@query("WITH {TX} SELECT tx_index, tx_index - w AS stream_idx, " + _SWAPPED.format("tx_index - w >= 3000") + ", CASE WHEN tx_index < w THEN 'warmup_baseline' WHEN tx_index - w < 3000 THEN 'baseline_concept_a' ELSE 'sudden_concept_b' END AS event_id FROM tx, size")
def inject_sudden(spark, d):
    return _drifted(spark, d, "sudden").select("tx_index", "stream_idx", "a", "b", "event_id")


_CYCLE = "(tx_index - w - 3000) // 1000"


@query("WITH {TX} SELECT tx_index, " + _SWAPPED.format(f"tx_index - w >= 3000 AND {_CYCLE} % 2 = 0") + f", CASE WHEN tx_index < w THEN 'warmup_baseline' WHEN tx_index - w < 3000 THEN 'recurring_pre_drift_a' ELSE concat('recurring_cycle_', CAST({_CYCLE} AS BIGINT), CASE WHEN {_CYCLE} % 2 = 0 THEN '_b' ELSE '_a' END) END AS event_id FROM tx, size")
def inject_recurring(spark, d):
    return _drifted(spark, d, "recurring").select("tx_index", "a", "b", "event_id")


@query("WITH {TX} SELECT tx_index, " + _SWAPPED.format("tx_index - w >= 3000 AND segment_key = 'view'") + ", CASE WHEN tx_index < w THEN 'warmup_baseline' WHEN tx_index - w < 3000 THEN 'localized_pre_drift_a' WHEN segment_key = 'view' THEN 'localized_target_segment_view_b' ELSE concat('localized_unaffected_segment_', segment_key, '_a') END AS event_id FROM tx, size")
def inject_localized(spark, d):
    return _drifted(spark, d, "localized").select("tx_index", "a", "b", "event_id")


@query("WITH {TX} SELECT tx_index, round(CASE WHEN i < 3000 THEN 0.0 WHEN i >= 5000 THEN 1.0 ELSE 1 / (1 + exp(-greatest(-50, least(50, 10.0 / 2000 * (i - 4000))))) END, 6) AS drift_prob FROM (SELECT tx_index, tx_index - w AS i FROM tx, size)")
def inject_gradual_prob(spark, d):
    return _drifted(spark, d, "gradual").select("tx_index", *six("drift_prob"))


@query()
def inject_gradual_draw(spark, d):
    return _drifted(spark, d, "gradual").select("tx_index", "is_affected", "event_id", "drift_prob")


@query("WITH {TX} SELECT CASE WHEN tx_index - w >= 3000 AND segment_key = 'view' THEN 'concept_b' ELSE 'concept_a' END AS active_concept, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive FROM tx, size GROUP BY 1")
def drift_meta_counts(spark, d):
    return _drifted(spark, d, "localized").groupBy("active_concept").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("n_positive"))


# --- event-centred metrics --------------------------------------------------------------------------------------

_T, _H = 3000, 2000


def _records(spark, d):
    df = stream(spark, d)
    n, w = sizes(df)
    records = events.placed(df.where(F.col("tx_index") >= w), w)
    return records, max(0, min(n - w - _T, _H))


_POS = "pos AS (SELECT tx_index - w AS pos, y_prob, y, segment_key FROM tx, size WHERE tx_index >= w)"


@query("WITH {TX}, " + _POS + ", q AS (SELECT CASE WHEN pos < 3000 THEN 'a' ELSE 'b' END AS ph, y_prob AS s, y FROM pos WHERE pos >= 1000 AND pos < 5000), " + ap_sql("q", "ph") + """
 SELECT round(max(ap) FILTER (WHERE ph = 'a'), 5) AS pre_ap, round(max(ap) FILTER (WHERE ph = 'b'), 5) AS post_ap, round(max(ap) FILTER (WHERE ph = 'b') - max(ap) FILTER (WHERE ph = 'a'), 5) AS delta,
 CAST(coalesce(max(n) FILTER (WHERE ph = 'a'), 0) AS BIGINT) AS n_pre, CAST(coalesce(max(n) FILTER (WHERE ph = 'b'), 0) AS BIGINT) AS n_post FROM ap""")
def event_pre_post_ap(spark, d):
    records, _ = _records(spark, d)
    return events.pre_post_ap(records, _T, _H)


@query("WITH {TX}, " + _POS + """, post AS (SELECT pos - 3000 AS i, y_prob, y FROM pos WHERE pos >= 3000 AND pos < 5000), np AS (SELECT count(*) AS n, greatest(50, count(*) // 20) AS step FROM post),
 ks AS (SELECT unnest(range(1, n // step + 1)) AS k, step FROM np), q AS (SELECT k, y_prob AS s, y FROM ks JOIN post ON i < k * step), """ + ap_sql("q", "k") + """
 SELECT round(CASE WHEN count(*) >= 3 AND max(np.n) >= 200 THEN regr_slope(ap, CAST(k * step - 1 AS DOUBLE)) END, 8) AS slope FROM (SELECT k, ap.ap AS ap FROM ap WHERE ap.ap IS NOT NULL) CROSS JOIN np""")
def degradation_slope(spark, d):
    records, n_post = _records(spark, d)
    return events.degradation_slope(records, _T, _H, n_post)


_ALARM_SQL = "al AS (SELECT pos, segment_key FROM pos WHERE y = 1 AND y_prob >= 0.97)"


def _events_of(records: DataFrame) -> DataFrame:
    """Stand-ins for alarms that SQL can name as well: positives with a very high score."""
    return records.where("y = 1 and y_prob >= 0.97")


@query("WITH {TX}, " + _POS + ", " + _ALARM_SQL + " SELECT count(*) FILTER (WHERE pos < 3000) AS false_alarms, min(pos) FILTER (WHERE pos >= 3000) AS first_alarm, min(pos) FILTER (WHERE pos >= 3000) - 3000 AS delay FROM al")
def detection_delay(spark, d):
    records, _ = _records(spark, d)
    return events.detection(_events_of(records), _T)


@query("WITH {TX}, " + _POS + ", " + _ALARM_SQL + """, o AS (SELECT pos AS onset, segment_key FROM pos WHERE pos % 100 = 0)
 SELECT o.segment_key, o.onset, al.pos AS first_alarm, al.pos - o.onset AS delay FROM o ASOF LEFT JOIN al ON o.segment_key = al.segment_key AND o.onset <= al.pos""")
def detection_delays(spark, d):
    """The delay of every one of many onsets, by segment: an as-of join of onsets and alarms."""
    records, _ = _records(spark, d)
    onsets = records.where(F.col("pos") % 100 == 0).select("segment_key", "pos")
    return events.detections(onsets, _events_of(records).select("segment_key", "pos"))


@query("""WITH {TX} SELECT tx_index, CAST(sum(y) OVER w AS BIGINT) AS n_positive, round(max(amount) OVER (PARTITION BY segment_key ORDER BY tx_index), 6) AS largest, last_value(CASE WHEN y = 1 THEN tx_index END IGNORE NULLS) OVER (PARTITION BY segment_key ORDER BY tx_index ROWS UNBOUNDED PRECEDING) AS last_positive
 FROM tx WINDOW w AS (ORDER BY tx_index)""")
def running_state(spark, d):
    """What a stream's reader knows at each row: prefix scans over all rows and within segments."""
    df = running(stream(spark, d).select("tx_index", "segment_key", "amount", "y"), {"n_positive": (SUM, F.col("y").cast("long"))})
    own = {"largest": (MAX, F.col("amount")), "last_positive": (LAST, F.when(F.col("y") == 1, F.col("tx_index")))}
    return running(df, own, "segment_key").select("tx_index", "n_positive", *six("largest"), "last_positive")


def _event_sql(segment: str | None) -> str:
    keep = f" WHERE segment_key = '{segment}'" if segment else ""
    return "WITH {TX}, " + _POS + ", seg AS (SELECT * FROM pos" + keep + "), " + _ALARM_SQL.replace("FROM pos", "FROM seg") + """, ad AS (SELECT pos, k / 1000.0 AS s FROM (SELECT tx_index - w AS pos, k FROM tx, size WHERE tx_index >= w AND (tx_index - w + 1) % 1000 = 0)),
 fl AS (SELECT y_prob AS s, y FROM seg), """ + ap_sql("fl").replace("g AS", "g0 AS", 1).replace("FROM g)", "FROM g0)").replace("r AS (SELECT *", "r0 AS (SELECT *", 1).replace("FROM r ", "FROM r0 ").replace("ap AS (SELECT max", "apf AS (SELECT max", 1) + """,
 ph AS (SELECT CASE WHEN pos < 3000 THEN 'a' ELSE 'b' END AS ph, y_prob AS s, y FROM seg WHERE pos >= 1000 AND pos < 5000), """ + ap_sql("ph", "ph").replace("g AS", "g1 AS", 1).replace("FROM g)", "FROM g1)").replace("r AS (SELECT *", "r1 AS (SELECT *", 1).replace("FROM r ", "FROM r1 ").replace("ap AS (SELECT ph", "app AS (SELECT ph", 1) + """,
 po AS (SELECT pos - 3000 AS x, row_number() OVER (ORDER BY pos) - 1 AS i, y_prob, y FROM seg WHERE pos >= 3000 AND pos < 5000), np AS (SELECT count(*) AS n, greatest(50, count(*) // 20) AS step FROM po),
 ks AS (SELECT unnest(range(1, n // step + 1)) AS k, step FROM np), pk AS (SELECT k, y_prob AS s, y, x FROM ks JOIN po ON i < k * step), px AS (SELECT k, CAST(max(x) AS DOUBLE) AS x FROM pk GROUP BY k), """ + ap_sql("pk", "k").replace("g AS", "g2 AS", 1).replace("FROM g)", "FROM g2)").replace("r AS (SELECT *", "r2 AS (SELECT *", 1).replace("FROM r ", "FROM r2 ").replace("ap AS (SELECT k", "apk AS (SELECT k", 1) + """,
 sl AS (SELECT round(CASE WHEN count(*) >= 3 AND (SELECT n FROM np) >= 200 THEN regr_slope(ap, x) END, 8) AS slope FROM apk JOIN px USING (k) WHERE ap IS NOT NULL),
 rk AS (SELECT unnest(range(0, n - 200 + 1)) AS k FROM np), rq AS (SELECT k, y_prob AS s, y, x FROM rk JOIN po ON i >= k AND i < k + 200), rx AS (SELECT k, max(x) AS x FROM rq GROUP BY k), """ + ap_sql("rq", "k").replace("g AS", "g3 AS", 1).replace("FROM g)", "FROM g3)").replace("r AS (SELECT *", "r3 AS (SELECT *", 1).replace("FROM r ", "FROM r3 ").replace("ap AS (SELECT k", "apr AS (SELECT k", 1) + """,
 pp AS (SELECT max(ap) FILTER (WHERE ph = 'a') AS a, max(ap) FILTER (WHERE ph = 'b') AS b, max(n) FILTER (WHERE ph = 'a') AS na, max(n) FILTER (WHERE ph = 'b') AS nb FROM app)
 SELECT 'sudden' AS regime, CAST(3000 AS BIGINT) AS t_drift, CAST(2000 AS BIGINT) AS horizon, round(a, 5) AS pre_drift_pr_auc, round(b, 5) AS post_drift_pr_auc, round(b - a, 5) AS delta_pr_auc, (SELECT slope FROM sl) AS degradation_slope,
 (SELECT min(pos) - 3000 FROM al WHERE pos >= 3000) AS detection_delay, (SELECT count(*) FROM al WHERE pos < 3000) AS false_alarms_before_drift, (SELECT min(x) FROM apr JOIN rx USING (k) WHERE ap >= a - 0.05) AS recovery_time,
 (SELECT count(*) FROM ad WHERE pos >= 3000) AS adaptation_count_post_drift, (SELECT coalesce(sum(s), 0.0) FROM ad WHERE pos >= 3000) AS total_retrain_time_post_s, (SELECT round(ap, 5) FROM apf) AS full_stream_pr_auc,
 CAST(coalesce(na, 0) AS BIGINT) AS n_pre_samples, CAST(coalesce(nb, 0) AS BIGINT) AS n_post_samples, CAST(""" + (f"'{segment}'" if segment else "NULL") + " AS VARCHAR) AS segment_evaluated FROM pp"


def _event_metrics(spark, d, segment):
    df = stream(spark, d)
    _, w = sizes(df)
    records = df.where(F.col("tx_index") >= w)
    retrains = df.join(_triggers(df, w), "tx_index").withColumn("duration_s", F.col("k") / 1000.0)
    return reports.event_metrics(records, _events_of(records), retrains, "sudden", _T, _H, 200, 0.05, segment, w)


@query(_event_sql(None))
def event_metrics(spark, d):
    return _event_metrics(spark, d, None)


@query(_event_sql("view"))
def event_metrics_segment(spark, d):
    return _event_metrics(spark, d, "view")


@query("WITH {TX}, " + _POS + """, post AS (SELECT pos - 3000 AS i, y_prob, y FROM pos WHERE pos >= 3000 AND pos < 5000), np AS (SELECT count(*) AS n FROM post),
 ks AS (SELECT unnest(range(0, n - 200 + 1)) AS k FROM np), q AS (SELECT k, y_prob AS s, y FROM ks JOIN post ON i >= k AND i < k + 200), """ + ap_sql("q", "k") + " SELECT min(k) + 199 AS recovery FROM ap WHERE ap >= 0.15")
def recovery_time(spark, d):
    records, n_post = _records(spark, d)
    return events.recovery_time(records, _T, _H, n_post, 200, 0.2)


@query("WITH {TX} SELECT coalesce(segment_key, 'global') AS stream_key, count(*) AS n_updates FROM tx GROUP BY GROUPING SETS ((segment_key), ())")
def update_counts_grouping_sets(spark, d):
    df = stream(spark, d).select("segment_key")
    return df.groupingSets([["segment_key"], []], "segment_key").agg(F.count("*").alias("n_updates")).select(F.coalesce("segment_key", F.lit("global")).alias("stream_key"), "n_updates")


# --- statistics -------------------------------------------------------------------------------------------------

_P_SQL = "p AS (SELECT CAST(user_id % 20 AS BIGINT) AS pos, round(avg(y_prob) * avg(y), 6) AS p FROM tx GROUP BY 1)"


def _p_values(spark, d):
    return stream(spark, d).groupBy((F.col("user_id") % 20).cast("long").alias("pos")).agg(F.round(F.avg("y_prob") * F.avg("y"), 6).alias("p"))


@query("WITH {TX}, " + _P_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY p, pos) AS i, count(*) OVER () AS m FROM p)
 SELECT pos, p, round(least(max(1 - pow(1 - p, m - i + 1)) OVER (ORDER BY p, pos ROWS UNBOUNDED PRECEDING), 1.0), 6) AS adjusted, p <= 1 - pow(0.95, 1.0 / (m - i + 1)) AS rejected FROM r""")
def holm_sidak(spark, d):
    return stats.holm_sidak(_p_values(spark, d)).select("pos", "p", *six("adjusted"), "rejected")


@query("WITH {TX}, " + _P_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY p, pos) AS i, count(*) OVER () AS m FROM p),
 a AS (SELECT pos, p, least(min(p * m / i) OVER (ORDER BY p DESC, pos DESC ROWS UNBOUNDED PRECEDING), 1.0) AS adjusted FROM r) SELECT pos, p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS rejected FROM a""")
def benjamini_hochberg(spark, d):
    return stats.benjamini_hochberg(_p_values(spark, d)).select("pos", "p", *six("adjusted"), "rejected")


_PAIRS_SQL = "pr AS (SELECT segment_key, user_id % 10 AS seed, avg(CASE WHEN k % 2 = 0 THEN y_prob END) AS x, avg(CASE WHEN k % 2 = 1 THEN y_prob END) AS yy FROM tx GROUP BY 1, 2), dd AS (SELECT segment_key, count(x - yy) AS n, avg(x - yy) AS m, stddev_samp(x - yy) AS s FROM pr GROUP BY 1)"


def _pairs(spark, d):
    even = F.avg(F.when(F.col("k") % 2 == 0, F.col("y_prob")))
    odd = F.avg(F.when(F.col("k") % 2 == 1, F.col("y_prob")))
    return stream(spark, d).groupBy("segment_key", (F.col("user_id") % 10).alias("seed")).agg(even.alias("x"), odd.alias("y"))


@query("WITH {TX}, " + _PAIRS_SQL + " SELECT segment_key, round(coalesce(m / nullif(s, 0), 0), 6) AS dz, round(coalesce(m / nullif(s, 0), 0) * CASE WHEN n > 2 THEN 1 - 3 / (4.0 * (n - 1) - 1) ELSE 1 END, 6) AS gz FROM dd WHERE n >= 2")
def cohens_dz_hedges_gz(spark, d):
    return stats.effect_sizes(_pairs(spark, d), "segment_key").select("segment_key", *six("dz", "gz"))


@query("WITH {TX}, " + _PAIRS_SQL + " SELECT segment_key, n, round(m, 6) AS mean_diff, round(s, 6) AS std_diff, round(m / (nullif(s, 0) / sqrt(n)), 6) AS t FROM dd WHERE n >= 2")
def paired_moments(spark, d):
    return stats.effect_sizes(_pairs(spark, d), "segment_key").select("segment_key", "n", *six("mean_diff", "std_diff", "t"))


@query("""WITH {TX}, z AS (SELECT segment_key AS a, user_id % 4 AS b, y_prob AS v FROM tx), t AS (SELECT count(*) AS n, avg(v) AS m, sum(v * v) AS q FROM z),
 c AS (SELECT a, b, count(*) AS n, avg(v) AS m FROM z GROUP BY a, b), ra AS (SELECT a, count(*) AS n, avg(v) AS m FROM z GROUP BY a), rb AS (SELECT b, count(*) AS n, avg(v) AS m FROM z GROUP BY b),
 s AS (SELECT (SELECT sum(ra.n * pow(ra.m - t.m, 2)) FROM ra) AS sa, (SELECT count(*) FROM ra) AS ka, (SELECT sum(rb.n * pow(rb.m - t.m, 2)) FROM rb) AS sb, (SELECT count(*) FROM rb) AS kb, (SELECT sum(c.n * pow(c.m - t.m, 2)) FROM c) AS sc, t.q - t.n * t.m * t.m AS st, t.n AS n FROM t),
 u AS (SELECT sa, sb, greatest(sc - sa - sb, 0.0) AS sab, greatest(st - sa - sb - greatest(sc - sa - sb, 0.0), 1e-12) AS se, ka - 1 AS da, kb - 1 AS db, (ka - 1) * (kb - 1) AS dab, greatest(n - ka * kb, 1) AS de FROM s)
 SELECT round(sa, 6) AS ss_a, round(sb, 6) AS ss_b, round(sab, 6) AS ss_ab, round(se, 6) AS ss_err, round((sa / da) / (se / de), 4) AS f_a, round((sb / db) / (se / de), 4) AS f_b, round((sab / dab) / (se / de), 4) AS f_ab, round(sab / (sab + se), 6) AS eta_ab FROM u""")
def anova_two_way(spark, d):
    df = stream(spark, d).select("segment_key", (F.col("user_id") % 4).alias("g"), "y_prob")
    out = stats.two_way_anova(df, "y_prob", "segment_key", "g")
    return out.select(*six("ss_a", "ss_b", "ss_ab", "ss_err"), *(F.round(f, 4).alias(f) for f in ("f_a", "f_b", "f_ab")), *six("eta_ab"))


@query("""WITH {TX}, m AS (SELECT segment_key, user_id % 6 AS p, round(avg(y_prob), 2) AS v FROM tx GROUP BY 1, 2), r AS (SELECT p, rank() OVER (PARTITION BY segment_key ORDER BY v) + (count(*) OVER (PARTITION BY segment_key, v) - 1) / 2.0 AS r FROM m),
 s AS (SELECT p, sum(r) AS r, count(*) AS m FROM r GROUP BY p), w AS (SELECT coalesce(var_pop(r) * count(*) / nullif(pow(max(m), 2) * (pow(count(*), 3) - count(*)) / 12, 0), 0) AS w FROM s) SELECT round(w, 6) AS w, w >= 0.7 AS concordant FROM w""")
def kendalls_w(spark, d):
    means = stream(spark, d).groupBy("segment_key", (F.col("user_id") % 6).alias("p")).agg(F.round(F.avg("y_prob"), 2).alias("v"))
    return stats.kendalls_w(means, "v", "p", "segment_key").select(*six("w"), "concordant")


# --- profiles ---------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'lang' AS "column", count(*) - count(lang) AS n_missing, round(100.0 * (count(*) - count(lang)) / count(*), 6) AS pct_missing FROM j
 UNION ALL SELECT 'quality', count(*) - count(quality), round(100.0 * (count(*) - count(quality)) / count(*), 6) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic), round(100.0 * (count(*) - count(toxic)) / count(*), 6) FROM j""")
def profile_missing(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    both = left_join(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id").drop("doc_id")
    return profile.missing(both).select("column", "n_missing", *six("pct_missing"))


@query("WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY 1, 2) SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates, round(100.0 * sum(c - 1) / sum(c), 6) AS pct FROM k")
def profile_duplicates(spark, d):
    return profile.duplicates(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber")).select("n_rows", "n_duplicates", *six("pct"))


@query("""WITH j AS (SELECT lang, source, quality FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT 'lang' AS "column", count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS n_unique FROM j UNION ALL SELECT 'source', count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) FROM j UNION ALL SELECT 'quality', count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) FROM j)
 SELECT "column", CAST(n_unique AS BIGINT) AS n_unique, CASE WHEN n_unique <= 1 THEN 'constant' WHEN n_unique = 2 THEN 'binary' WHEN n_unique <= 20 THEN 'low' ELSE 'high' END AS bucket FROM c""")
def profile_cardinality(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    return profile.cardinality(left_join(docs, labels, "doc_id").drop("doc_id"))


@query("WITH {TX} SELECT y AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM tx GROUP BY y")
def class_distribution(spark, d):
    return profile.class_mix(stream(spark, d), "y")


@query("WITH {TX} SELECT segment_key AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM tx GROUP BY segment_key")
def segment_mix(spark, d):
    return profile.class_mix(stream(spark, d), "segment_key")


@query("WITH {TX} SELECT min(tx_id) AS first, max(tx_id) AS last, round(avg(y), 6) AS rate, string_agg(DISTINCT segment_key, ',' ORDER BY segment_key) AS segments FROM tx")
def stream_stats(spark, d):
    return profile.stream_stats(stream(spark, d), "tx_id", "y", "segment_key").select("first", "last", *six("rate"), "segments")


# --- jobs and artifacts -----------------------------------------------------------------------------------------

_GRID_SQL = "grid AS (SELECT concat('e3_', p, '_', r, '_W10000_seed', s) AS job_id, p AS policy, r AS regime, CAST(s AS INTEGER) AS seed FROM (SELECT unnest(['P0','P1','P2','P3']) AS p), (SELECT unnest(['sudden','gradual','recurring','localized']) AS r), (SELECT unnest([42,101,123,256,314,420,555,666,777,909]) AS s))"
#: Seeds of the experiment grid.
SEEDS = (42, 101, 123, 256, 314, 420, 555, 666, 777, 909)


def grid(spark: SparkSession) -> DataFrame:
    """Every (policy, regime, seed): three explodes of constants."""
    each = lambda *v: F.explode(F.array(*map(F.lit, v)))
    rows = spark.range(1).select(each("P0", "P1", "P2", "P3").alias("policy")).select("policy", each(*inject.REGIMES).alias("regime"))
    rows = rows.select("policy", "regime", each(*SEEDS).alias("seed"))
    return rows.select(F.concat(F.lit("e3_"), "policy", F.lit("_"), "regime", F.lit("_W10000_seed"), F.col("seed").cast("string")).alias("job_id"), "policy", "regime", "seed")


@query("WITH {TX}, " + _GRID_SQL + """, hit AS (SELECT 'sudden' AS regime, count(*) AS n_affected FROM tx, size WHERE tx_index - w >= 3000 UNION ALL SELECT 'recurring', count(*) FROM tx, size WHERE tx_index - w >= 3000 AND (tx_index - w - 3000) // 1000 % 2 = 0
 UNION ALL SELECT 'localized', count(*) FROM tx, size WHERE tx_index - w >= 3000 AND segment_key = 'view') SELECT grid.*, n_affected FROM grid LEFT JOIN hit USING (regime)""")
def job_grid(spark, d):
    """The jobs of the experiment with the number of rows that their regime affects (null where a draw decides)."""
    hit = [_drifted(spark, d, r).agg(F.lit(r).alias("regime"), F.count_if("is_affected").alias("n_affected")) for r in inject.REGIMES if r != "gradual"]
    table = hit[0]
    for more in hit[1:]:
        table = table.unionByName(more)
    return grid(spark).join(F.broadcast(table), "regime", "left").select("job_id", "policy", "regime", "seed", "n_affected")  # a row a regime


_JOBS_SQL = "jobs AS (SELECT DISTINCT concat('m_', segment_key, '_seed', user_id % 50) AS job_id, segment_key AS policy FROM tx), done AS (SELECT DISTINCT concat('m_', segment_key, '_seed', user_id % 50) AS job_id FROM tx WHERE y = 1 AND y_prob > 0.9)"


@query("WITH {TX}, " + _JOBS_SQL + " SELECT job_id, policy FROM jobs WHERE job_id NOT IN (SELECT job_id FROM done)")
def resume_anti_join(spark, d):
    """Jobs (a segment and a seed of its users) that have no committed result yet."""
    name = F.concat(F.lit("m_"), "segment_key", F.lit("_seed"), (F.col("user_id") % 50).cast("string")).alias("job_id")
    df = stream(spark, d)
    store = RunTables(spark, scratch(spark, "resumed"))
    done = df.where("y = 1 and y_prob > 0.9").select(name, F.lit(1.0).alias("figure")).distinct()
    store.commit(done)
    return store.remaining(df.select(name, F.col("segment_key").alias("policy")).distinct()).select("job_id", "policy")


_RUN_SQL = "runs AS (SELECT segment_key AS policy, user_id % 5 AS seed, round(avg(y_prob), 6) AS v FROM tx GROUP BY 1, 2)"


def _runs(spark, d):
    return stream(spark, d).groupBy(F.col("segment_key").alias("policy"), (F.col("user_id") % 5).alias("seed")).agg(F.round(F.avg("y_prob"), 6).alias("v"))


@query("WITH {TX}, " + _RUN_SQL + " SELECT policy, CAST(seed AS BIGINT) AS seed, round(v - (SELECT v FROM runs WHERE policy = 'click' AND seed = 0), 6) AS delta FROM runs")
def baseline_delta(spark, d):
    runs = _runs(spark, d)
    base = runs.where("policy = 'click' and seed = 0").select(F.col("v").alias("base"))
    return runs.crossJoin(F.broadcast(base)).select("policy", F.col("seed").cast("long").alias("seed"), F.round(F.col("v") - F.col("base"), 6).alias("delta"))


@query("WITH {TX}, " + _RUN_SQL + " SELECT policy, round(stddev_pop(v), 6) AS spread, stddev_pop(v) = 0 AS invariant FROM runs GROUP BY policy")
def seed_invariance(spark, d):
    return _runs(spark, d).groupBy("policy").agg(F.round(F.stddev_pop("v"), 6).alias("spread"), (F.stddev_pop("v") == 0).alias("invariant"))


@query("WITH {TX} SELECT segment_key AS policy, count(*) AS n_events, CAST(sum(k) AS DOUBLE) AS total, round(avg(CAST(k AS DOUBLE)), 6) AS mean FROM tx GROUP BY 1")
def artifact_json_explode(spark, d):
    """Totals from runs' JSON logs: logs are written as JSON in pieces of bounded size, parsed, and exploded."""
    log = F.to_json(F.collect_list(F.struct("tx_index", F.col("k").cast("double").alias("duration_s"))))
    logs = stream(spark, d).groupBy(F.col("segment_key").alias("policy"), F.floor(F.col("tx_index") / 1000).alias("piece")).agg(log.alias("log"))
    rows = logs.select("policy", F.explode(F.from_json("log", "array<struct<tx_index: bigint, duration_s: double>>")).alias("e"))
    return rows.groupBy("policy").agg(F.count("*").alias("n_events"), F.sum("e.duration_s").alias("total"), F.round(F.avg("e.duration_s"), 6).alias("mean"))


# --- reports ----------------------------------------------------------------------------------------------------


@query("WITH {TX}, " + _POS + ", " + _ALARM_SQL + " SELECT segment_key AS stream_key, count(*) AS n FROM al GROUP BY 1")
def drift_counts(spark, d):
    records, _ = _records(spark, d)
    return reports.drift_counts(_events_of(records), "segment_key")


@query("SELECT DISTINCT event_type AS segment_key FROM events WHERE event_type IS NOT NULL")
def known_segments(spark, d):
    return reports.known_segments(stream(spark, d))


_LOG_SQL = "lg AS (SELECT tx_index, 'P1:periodic:every_1000_tx' AS trigger, k / 1000.0 AS s FROM tx, size WHERE tx_index >= w AND (tx_index - w + 1) % 1000 = 0)"


def _log(spark, d):
    """The retrain log of P1: its triggers are a function of the position."""
    df = stream(spark, d)
    _, w = sizes(df)
    due = (F.col("tx_index") >= w) & ((F.col("tx_index") - w + 1) % WINDOW == 0)
    rows = df.withColumn("adaptation_scope", F.when(due, "global")).withColumn("adapted", due).withColumn("duration_s", F.col("k") / 1000.0)
    return reports.adaptation_log(rows, "P1", WINDOW)


@query("WITH {TX}, " + _LOG_SQL + " SELECT 'P1' AS policy, tx_index, 'global' AS scope, s AS duration_s, trigger, row_number() OVER (ORDER BY tx_index) - 1 AS adaptation_event_index, true AS trigger_occurred, true AS replacement_performed FROM lg")
def adaptation_log(spark, d):
    return _log(spark, d)


@query("WITH {TX}, " + _LOG_SQL + " SELECT trigger, count(*) AS n_adaptations, round(sum(s), 6) AS total_s FROM lg GROUP BY 1")
def adaptation_totals(spark, d):
    return reports.adaptation_totals(_log(spark, d), "trigger").withColumn("total_s", F.round("total_s", 6))


@query("WITH h AS (" + _SQL["pre_post_horizon_ap"] + ") SELECT count(*) AS n_events, round(avg(pre_ap), 5) AS mean_pre, round(avg(post_ap), 5) AS mean_post, round(avg(delta), 5) AS mean_delta, count(*) FILTER (WHERE delta < 0) AS n_drops, round(count(*) FILTER (WHERE delta < 0) / nullif(count(delta), 0), 6) AS drop_share FROM h")
def horizon_means(spark, d):
    out = reports.horizon_means(pre_post_horizon_ap(spark, d))
    return out.select("n_events", *(F.round(c, 5).alias(c) for c in ("mean_pre", "mean_post", "mean_delta")), "n_drops", F.round("drop_share", 6).alias("drop_share"))


@query("WITH {TX}, q AS (SELECT y_prob AS s, y FROM tx, size WHERE tx_index >= w), " + ap_sql("q") + ", " + _POS + ", " + _ALARM_SQL + ", " + _LOG_SQL + ", c AS (" + _CONF.format(g="", by="").replace("FROM tx)", "FROM tx, size WHERE tx_index >= w)") + """)
 SELECT 'P1' AS policy, 'adwin' AS detector_type, w AS n_warmup, size.n - w AS n_stream, 2.5 AS total_wall_time_s, round(ap, 6) AS pr_auc, round(roc, 6) AS roc_auc, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
 (SELECT round(quantile_cont(CAST(k AS DOUBLE) / 1000, 0.95), 6) FROM tx) AS latency_p95_s, (SELECT count(*) FROM lg) AS n_adaptations, (SELECT count(*) FROM al) AS n_drift_events, (size.n - w) / 2.5 AS throughput_tx_per_sec FROM ap, c, size""")
def run_summary(spark, d):
    df = stream(spark, d)
    n, w = sizes(df)
    records = df.where(F.col("tx_index") >= w)
    latency = metrics.latency_percentiles(df.withColumn("latency", F.col("k") / F.lit(1000.0)), "latency")
    run = {"policy": "P1", "detector_type": "adwin", "n_warmup": w, "n_stream": n - w, "total_wall_time_s": 2.5}
    out = reports.run_summary(metrics.snapshot(records), _log(spark, d), _events_of(records), latency, run)
    return out.select(*(F.round(c, 6).alias(c) if c in ("pr_auc", "roc_auc", "f1", "recall", "latency_p95_s") else F.col(c).cast("long").alias(c) if c[:2] == "n_" else F.col(c) for c in out.columns))


@query("WITH {TX} SELECT segment_key, round(avg(k) / 1000.0 * 1000.0, 4) AS p50_ms, round(count(*) / (sum(k) / 1000.0), 4) AS per_second FROM tx GROUP BY 1")
def throughput_and_ms(spark, d):
    per = stream(spark, d).groupBy("segment_key").agg((F.avg("k") / 1000.0).alias("p"), F.count("*").alias("n"), (F.sum("k") / 1000.0).alias("s"))
    none = F.lit(None).cast("double")
    return per.select("segment_key", reports.milliseconds(F.col("p"), none).alias("p50_ms"), F.round(reports.throughput(F.col("n"), F.col("s")), 4).alias("per_second"))


@query("WITH {TX}, " + _RUN_SQL + ", p AS (SELECT a.v - b.v AS d FROM runs a JOIN runs b USING (seed) WHERE a.policy = 'click' AND b.policy = 'view') SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS std_diff FROM p")
def paired_by_seed(spark, d):
    pairs = reports.paired_by_seed(_runs(spark, d), "click", "view", "v")
    return stats.effect_sizes(pairs).select("n", *six("mean_diff", "std_diff"))


@query("WITH {TX} SELECT segment_key, tx_index, tx_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_key ORDER BY amount DESC, tx_index) AS r FROM tx) WHERE r = 1")
def first_member(spark, d):
    rows = stream(spark, d).select("segment_key", "tx_index", "tx_id", "amount")
    return reports.first_member(rows, ["segment_key"], F.desc("amount"), "tx_index").drop("amount")


def _labelled(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    return left_join(docs, spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query("""WITH j AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT 'lang' AS "column", count(*) - count(lang) AS n_missing, count(*) AS n FROM j UNION ALL SELECT 'source', count(*) - count(source), count(*) FROM j
 UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM j UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM j) SELECT "column", n_missing, round(100.0 * n_missing / n, 6) AS pct_missing FROM c WHERE n_missing > 0""")
def missing_sorted(spark, d):
    return reports.missing_sorted(_labelled(spark, d).drop("doc_id")).select("column", "n_missing", *six("pct_missing"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE starts_with(source, 'src1') AND contains(source, '5')")
def named_like(spark, d):
    return reports.named_like(spark.read.parquet(f"{d}/documents.parquet"), "source", "src1", "5").select("doc_id", "source", "n_chars")


@query("""SELECT 'orders' AS name, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS n_missing, 0.0 AS pct_missing FROM orders
 UNION ALL SELECT 'labelled', count(*), CAST(5 AS BIGINT), CAST(5 * count(*) - count(doc_id) - count(lang) - count(source) - count(quality) - count(toxic) AS BIGINT), round(100.0 * (5 * count(*) - count(doc_id) - count(lang) - count(source) - count(quality) - count(toxic)) / (5 * count(*)), 6) FROM documents LEFT JOIN labels USING (doc_id)""")
def frame_profile(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    out = reports.frame_profile({"orders": orders, "labelled": _labelled(spark, d)})
    return out.select("name", "n_rows", "n_columns", "n_missing", *six("pct_missing"))


@query('SELECT l_returnflag, round(sum(l_quantity), 4) AS total, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1')
def chart_totals(spark, d):
    out = reports.chart(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_quantity")
    return out.select("l_returnflag", F.round("total", 4).alias("total"), "most", F.round("mean", 6).alias("mean"), "n")


@query("WITH {TX} SELECT round(avg(CASE WHEN tx_index - w >= 3000 AND segment_key = 'view' AND amount IS DISTINCT FROM CAST(k AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS changed_share, round(avg(y), 6) AS prevalence_before, round(avg(y), 6) AS prevalence_after FROM tx, size")
def injection_effect(spark, d):
    before = stream(spark, d).withColumn("a", F.col("amount")).withColumn("b", F.col("k").cast("double"))
    out = reports.injection_effect(before, _drifted(spark, d, "localized"), ["a", "b"])
    return out.select(*six(*out.columns))


@query("WITH {TX} SELECT tx_index, tx_id, quality FROM (SELECT * FROM tx WHERE tx_index < 500) LEFT JOIN labels ON doc_id = tx_id")
def sliced_join(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("tx_id"), "quality")
    return datasets.sliced_join(stream(spark, d), labels, "tx_id", 500).select("tx_index", "tx_id", "quality")


# --- stateful operators -----------------------------------------------------------------------------------------

FEATURES = ["amount", "k", "hour"]


def _learnable(spark, d):
    """The stream with features that carry its label (y is amount > 120) and others that do not."""
    return stream(spark, d).withColumn("hour", F.hour(F.col("ts").cast("timestamp")).cast("double"))


def _run(policy: str, **kw) -> Query:
    def run(spark, d):
        df = _learnable(spark, d)
        _, w = sizes(df)
        cfg = fold.RunConfig(policy, policy, warmup=w, window=WINDOW, interval=2000, grace_period=200, delta=0.002, **kw)
        return fold.prequential(df, FEATURES, cfg)

    return run


for _p in ("P0", "P1", "P2", "P3"):
    _QUERIES[f"prequential_{_p.lower()}"] = _run(_p)
_QUERIES["prequential_no_swap"] = _run("P1", no_swap=True)
_QUERIES["prequential_frozen"] = _run("P0", frozen=True)


@query("""WITH {TX} SELECT tx_index, y AS y_true, segment_key, (tx_index - w + 1) % 2000 = 0 AS adapted, CASE WHEN (tx_index - w + 1) % 2000 = 0 THEN 'global' END AS adaptation_scope, true AS consistent,
 CASE WHEN (tx_index - w + 1) % 2000 = 0 THEN least(1000, tx_index + 1) END AS n_window, CASE WHEN (tx_index - w + 1) % 2000 = 0 THEN CAST(sum(y) OVER (ORDER BY tx_index ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS INTEGER) END AS n_fraud_window FROM tx, size QUALIFY tx_index >= w""")
def prequential_p1_log(spark, d):
    """What a run of P1 must record whatever its learner predicts."""
    return _p1_log(_run("P1")(spark, d))


def _p1_log(out: DataFrame, *more: str) -> DataFrame:
    fine = (F.col("y_pred") == (F.col("y_prob") >= 0.5).cast("int")) & (F.col("error") == F.abs(F.col("y_true") - F.col("y_pred"))) & F.col("y_prob").between(0, 1)
    return out.select(*more, "tx_index", "y_true", "segment_key", "adapted", "adaptation_scope", fine.alias("consistent"), F.col("n_window").cast("long").alias("n_window"), "n_fraud_window")


_LOG_OF = _SQL["prequential_p1_log"].split("SELECT tx_index, y AS y_true")[1]


@query(_SQL["prequential_p1_log"].split("SELECT tx_index, y AS y_true")[0] + " UNION ALL ".join(f"(SELECT 'every_{n}' AS job_id, tx_index, y AS y_true" + _LOG_OF.replace("2000", str(n)) + ")" for n in (2000, 1500)))
def grid_p1_logs(spark, d):
    """Several runs as one plan, their records kept as tables by job; a job that was never committed is not read."""
    df = _learnable(spark, d)
    _, w = sizes(df)
    cfgs = [fold.RunConfig(f"every_{n}", "P1", warmup=w, window=WINDOW, interval=n, grace_period=200, delta=0.002) for n in (2000, 1500, 700)]
    store = RunTables(spark, scratch(spark, "runs"))
    store.write("records", run_grid(df, FEATURES, cfgs).withColumnRenamed("run_id", "job_id"))
    figures = store.read_all("records").groupBy("job_id").agg(F.count("*").alias("n_stream"), F.count_if("adapted").alias("adaptation_count"))
    store.commit(figures.where("job_id != 'every_700'"))
    return _p1_log(store.read("records"), "job_id")


@query(_SQL["prequential_p1_log"])
def stateful_p1_log(spark, d):
    """The same log from a stream that arrives in three parts, each read by a restarted query with the same checkpoint."""
    df = _learnable(spark, d)
    n, w = sizes(df)
    rows = df.select("tx_index", "y", "segment_key", *(F.col(f).cast("double").alias(f) for f in FEATURES))
    cfg = fold.RunConfig("P1", "P1", warmup=w, window=WINDOW, interval=2000, grace_period=200, delta=0.002)
    source, out, checkpoint = (scratch(spark, name) for name in ("source", "records", "stream"))
    before = spark.conf.get(keyed.PROVIDER, None)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    try:
        for part in range(3):
            rows.where((F.col("tx_index") >= n * part // 3) & (F.col("tx_index") < n * (part + 1) // 3)).write.mode("append").parquet(source)
            records = keyed.stateful(spark.readStream.schema(rows.schema).parquet(source), FEATURES, cfg)
            keyed.to_table(records, out, checkpoint).awaitTermination()
    finally:
        spark.conf.unset(keyed.PROVIDER) if before is None else spark.conf.set(keyed.PROVIDER, before)
    return _p1_log(spark.read.parquet(out))


def _alarms(kind: str) -> Query:
    def run(spark, d):
        error = F.abs(F.col("y") - metrics.decision("y_prob"))
        shifted = F.when(F.col("tx_index") % 4000 >= 2000, F.lit(1)).otherwise(error)
        df = stream(spark, d).withColumn("error", shifted)
        return fold.alarms(df, kind).unionByName(fold.alarms(df, kind, "segment_key"))

    return run


_QUERIES["adwin_events"], _QUERIES["hddm_events"] = _alarms("adwin"), _alarms("hddm_a")
_QUERIES["hddm_w_events"] = _alarms("hddm_w")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
