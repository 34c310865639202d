"""Connected components of a graph that may be as large as the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` that is not its component's smallest node.

    Alternates large and small stars until nothing changes; a node of any degree is only ever grouped
    by partial minima and joined. Loops and NULL ends are ignored.
    """
    edges = checkpointed(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)))
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(new)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
