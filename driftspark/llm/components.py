"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is one shuffle of the links that are left; a node with very many neighbours is only ever aggregated (min)
and joined, never collected. Each round is written to shared scratch space, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm._common import cut


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node of its component) for every node of links (a, b longs); self-links are ignored."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    edges = cut(edges, "links")
    last = None
    while True:
        edges = cut(_small_star(_large_star(edges)), "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return out.union(least.select("a", F.col("m").alias("b"))).distinct()
