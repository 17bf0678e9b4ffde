"""Runs the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and threads."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "metric_snapshot_by_segment", "average_precision", "prep_transform_scaled", "window_stats_segment", "rolling_pr_auc_trajectory",
    "inject_localized", "event_pre_post_ap", "degradation_slope", "anova_two_way", "profile_duplicates", "profile_cardinality",
    "left_join_labels", "prequential_p0", "prequential_p1", "prequential_p3",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from driftspark import queries as Q

    out, all_queries = {}, Q.queries()
    began = time.perf_counter()
    Q.stream(spark, sf_dir).count()  # built once and reused by the queries
    out["index_build"] = round(time.perf_counter() - began, 3)
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
