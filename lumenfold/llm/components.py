"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour (or the node itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the smallest of them. Edges come as larger, smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns a, b: integers); component is its smallest reachable node.

    Links to oneself, null ends, repeated and reversed links are allowed. Hubs are joined to one row of their own, so
    Spark can split them. Each round is a written table; rounds grow with the logarithm of the longest path."""
    clean = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(clean, "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    state = None
    for _ in range(most_rounds if edges.limit(1).count() else 0):
        edges = written(_small_star(_large_star(edges)), "cc-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    else:
        if state is not None:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
