"""Exact cosine search over an array column, grouped best hits, centroids, and the default embedder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search(chunks: DataFrame, vector: Sequence[float], k: int, where: Column | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows nearest to a unit vector. The filter runs before any score; only k rows a partition travel."""
    kept = chunks if where is None else chunks.filter(where)
    return kept.withColumn("score", dot(F.col(vector_col), literal(vector))).orderBy(F.desc("score"), id_col).limit(k)


def centroids(chunks: DataFrame, group_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """Each group's mean vector at unit length. Components are averaged by position, combined before they are shuffled."""
    parts = chunks.select(group_col, F.posexplode(vector_col).alias("pos", "x"))
    means = parts.groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy(group_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return vectors.select(group_col, normalised(F.col("v")).alias("centroid"))


def best_in_groups(chunks: DataFrame, centroid: DataFrame, group_col: str = "doc_id", id_col: str = "chunk_id", vector_col: str = "embedding", limit: int | None = 3, threshold: float | None = 0.90, most_groups: int = 10_000) -> DataFrame:
    """For each centroid (group_col, centroid) the best row of every other group: source, group, id, score (4 digits).

    The first ``limit`` groups are taken before the threshold. Centroids are broadcast behind a check of their number: more
    than ``most_groups`` go in portions of about half as many, each of which meets all rows."""
    portions = max(1, -(-2 * n // most_groups)) if (n := centroid.count()) > most_groups else 1
    own = chunks.select(F.col(group_col).alias("__group"), F.col(id_col), F.col(vector_col).alias("__vector"))
    goal = centroid.select(F.col(group_col).alias("source"), "centroid")

    def scored(part: DataFrame) -> DataFrame:
        return own.join(F.broadcast(part), F.col("source") != F.col("__group")).select("source", F.col("__group").alias(group_col), id_col, dot(F.col("__vector"), F.col("centroid")).alias("score"))

    pairs = scored(goal.filter(F.pmod(F.xxhash64("source"), F.lit(portions)) == 0) if portions > 1 else goal)
    for i in range(1, portions):
        pairs = pairs.union(scored(goal.filter(F.pmod(F.xxhash64("source"), F.lit(portions)) == i)))
    best = pairs.groupBy("source", group_col).agg(F.max_by(F.struct("score", id_col), F.struct("score", -F.col(id_col)) if dict(chunks.dtypes)[id_col] in ("bigint", "int") else F.struct("score", id_col)).alias("b"))
    best = best.select("source", group_col, F.col(f"b.{id_col}").alias(id_col), F.round("b.score", 4).alias("score"))
    if limit is not None:
        best = best.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), group_col))).filter(F.col("rn") <= limit).drop("rn")
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def by_ids(chunks: DataFrame, ids: Sequence[str], id_col: str = "chunk_id") -> DataFrame:
    """Rows of the asked ids in the order they were asked for."""
    order = chunks.sparkSession.createDataFrame([(x, i) for i, x in enumerate(dict.fromkeys(ids))], f"{id_col} string, pos int")
    return chunks.join(F.broadcast(order), id_col).orderBy("pos").drop("pos")


class HashedEmbedder:
    """Deterministic offline stand-in: hashed character n-grams at unit length. Any callable text -> vector can replace it."""

    def __init__(self, dim: int = 384, n: int = 3):
        self.dim, self.n = dim, n

    def __call__(self, text: str) -> list[float]:
        import zlib

        import numpy as np

        out, folded = np.zeros(self.dim), f" {' '.join(text.casefold().split())} "
        for i in range(max(0, len(folded) - self.n + 1)):
            h = zlib.crc32(folded[i : i + self.n].encode())
            out[h % self.dim] += 1 if h & 0x80000000 else -1
        size = float(np.linalg.norm(out))
        return (out / size if size else out).tolist()


def embedded(df: DataFrame, embed: Callable[[str], Sequence[float]], text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Adds the texts' vectors, an Arrow batch at a time."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in embed(t or "")])

    return df.withColumn(out_col, run(F.col(text_col)))
