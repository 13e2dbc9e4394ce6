"""Connected components of a link table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's smallest neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.filter("v > u").join(least, "u")
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    moved = linked.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.union(own).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node and root (the smallest node that links reach) of every node of ``edges`` (a < b).

    Edges keep to O(rows) in each round, a hub's edges are never gathered: a round is grouped
    minima and joins. Each round is written to the shared folder, which ends the lineage.
    """
    now = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = materialize(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select("a", "a").distinct()
    )
