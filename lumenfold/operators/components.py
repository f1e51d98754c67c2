"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for the nodes of (``a``, ``b``) edges.

    Each round links every node's larger neighbours, and itself, to its smallest neighbour, then every smaller one; what is
    left at the end are stars around the smallest nodes. Edges are made distinct before each shuffle, and a node's neighbours
    are never gathered: only their minimum is."""
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = written(small, "links")
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
            return roots.union(alone.select("node", F.col("node").alias("root")))
        links = after
