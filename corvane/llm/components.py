"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored

#: Edges up to which the nodes' smallest neighbours are broadcast: the many edges of one node then stay where they are.
BROADCAST_EDGES = 200_000


def _large_star(edges: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every neighbour larger than a node moves to the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(side(least), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node with a link; component is its smallest node.

    Large-star and small-star steps alternate until the edges no longer change;
    each round's edges are a table in the shared folder. Nothing is collected but
    three numbers a round. Self-links and nulls are ignored.
    """
    current = stored(
        edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components"
    )
    for _ in range(max_rounds):
        side = F.broadcast if current.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES else shuffled
        following = stored(_small_star(_large_star(current, side), side), "components")
        # a star forest: no centre is a leaf, and every leaf has one centre
        leaves = following.groupBy("u").agg(F.count("*").alias("n"))
        centres = following.select(F.col("v").alias("u")).distinct()
        unsettled = leaves.where("n > 1").select("u").union(leaves.join(side(centres), "u", "left_semi").select("u"))
        current = following
        if unsettled.isEmpty():
            leaf = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            centre = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return leaf.union(centre)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
