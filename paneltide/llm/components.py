"""Connected components of a graph given as edges between long numbers, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.session import materialized


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest number around the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that has an edge and is not its component's smallest.

    ``edges`` has the long columns a and b. Each round is written and read back, so
    the plan stays short; a hub is met by a partial minimum and a join that can be split.
    The number of rounds grows with the logarithm of the longest path.
    """
    now = materialized(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        row = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == mark or row["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (row["n"], row["h"])
        now = materialized(_small_star(_large_star(now)))
