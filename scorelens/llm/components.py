"""Connected components of an edge table by alternating star contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b): each node's chosen neighbours are tied to the least node around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.where(F.col("b") > F.col("a")) if large else both
    out = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Rounds are about the logarithm of the longest chain; each is a table in the shared scratch folder.
    Nulls and loops are no edges."""
    edges = stored(edges.where("a != b").select("a", "b").distinct(), name)
    for _ in range(most_rounds):
        heads = edges.select(F.col("b").alias("a")).distinct()
        several = edges.groupBy("a").count().where("count > 1").select("a")
        open_ = edges.where("b > a").select("a").union(edges.join(heads, "a", "left_semi").select("a")).union(several)
        if not open_.take(1):
            break
        edges = stored(_star(_star(edges, True), False), name)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
