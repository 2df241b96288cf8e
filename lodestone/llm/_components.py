"""Connected components by alternating large-star and small-star steps, all of them joins and aggregates.

Every edge points from the greater node to the smaller. The graph is a forest of stars, and so done, when each
node has one smaller neighbour and none that it points to has a smaller one. Only nodes for which that does not
hold yet enter a join, so the centre of a star, however many nodes point to it, is never a join key on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _shared


def _lower(edges: DataFrame) -> DataFrame:
    """Least and greatest smaller neighbour of each node; summed ahead of the shuffle."""
    return _shared.written(edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")), "edges-lower")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long) but roots: the least node it reaches.

    Each step is written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    now = _shared.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        lower = _lower(now)
        many = lower.where("low < high").count()
        ends = now.select(F.col("b").alias("a")).distinct()
        movers = _shared.written(lower.join(ends, "a", "left_semi").select(F.col("a").alias("b"), "low"), "edges-movers")
        moving = movers.count()
        if not many and not moving:
            return lower.select(F.col("a").alias("node"), F.col("low").alias("root"))
        if moving:
            # Large star: who points to a node that points lower goes to that node's least neighbour.
            small = F.broadcast(movers) if moving <= _shared.MOST_IDS else movers
            now = _shared.written(now.join(small, "b", "left").select("a", F.coalesce("low", "b").alias("b")).distinct(), "edges")
            lower = _lower(now)
        # Small star: a node and all its smaller neighbours go to the least of them.
        split = lower.where("low < high").select("a", "low")
        moved = _shared.joined(now, split, ["a"], name="edges-split").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = _shared.written(moved.unionByName(lower.select("a", F.col("low").alias("b"))).distinct(), "edges")
    raise RuntimeError("components did not settle")
