"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no task ever holds a component, and AQE splits
the join of a node with very many links. The loop ends when the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Large: larger neighbours move to the least; small: the others do."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node has one smaller neighbour, which has none itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b); component is its least node.

    Self links, repeated links and either direction are allowed; rows with a null are ignored.
    An empty table gives an empty result. Nodes without a link to another node don't appear.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        now = cut(_star(_star(now, True), False))
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
