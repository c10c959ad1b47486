"""Connected components by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmesh.llm.common import saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b), the root being the smallest reachable node.

    Alternating stars: nodes are re-linked to the smallest node they know of, first
    their larger neighbours, then their smaller ones, until every node hangs on
    its root. The number of rounds grows with the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = saved(now, "links"), None
    for _ in range(max_rounds):
        now = saved(_small_star(_large_star(now)), "links")
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
    raise RuntimeError("links did not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger to the smaller node here."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
