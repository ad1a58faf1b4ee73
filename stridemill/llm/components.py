"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _with_least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) with m, the least of u and its v; and the minima, which are written first, so that a node with very many
    neighbours is a skewed join, which Spark splits, and not one task's group."""
    least = stored(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("k"), "m"), "least")
    return rows.join(least, F.col("u") == F.col("k")).drop("k"), least


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long) that isn't its component's smallest node.

    Each round is written to the shared folder, which cuts lineage; it ends when a round changes nothing. The rounds
    grow with the logarithm of the longest path. No edges give no rows; loops and repeated edges don't matter.
    """
    edges = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = stored(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        joined, first = _with_least(both)
        large = stored(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        joined, second = _with_least(large)
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, edges = edges, stored(small.filter("u <> v").distinct(), "edges")
        forget(old, both, first, large, second)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")
