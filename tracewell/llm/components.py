"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_nearest(both), "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _nearest(down)
    joined = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of the edges (a, b).

    Each round writes its edges to the shared folder, so a lost executor costs one round. A
    node's neighbours are never gathered: only their minimum is, by partial aggregates. Rounds
    grow with the logarithm of the longest chain.
    """
    now = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    state = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        summary = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if summary == state:
            break
        state = summary
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
