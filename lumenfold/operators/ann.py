"""Approximate nearest neighbours: vectors lie in cells around centroids, a question reads the nearest cells and scores their
rows exactly.

Centroids come from a bounded sample; every row gets a cell. Cells are the buckets of a stored table, so rows of other cells
are neither listed nor read. How many cells a question reads is its trade of work for recall; all cells give the exact rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumenfold.operators import vectors


def fit_centroids(rows: DataFrame, cells: int, vector_col: str = "embedding", id_col: str = "chunk_id", sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means on up to ``sample`` rows, those of smallest hash of their id. Fewer different
    vectors than ``cells`` give fewer centroids."""
    few = rows.filter(F.col(vector_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(vector_col).alias("v")).orderBy("h").limit(sample)
    points = [r["v"] for r in few.collect()]
    data = np.unique(np.array(points, dtype=np.float64), axis=0) if points else np.zeros((0, 1))
    rnd = np.random.default_rng(3)
    centres = data[rnd.permutation(len(data))[:cells]]
    for _ in range(rounds):
        if not len(centres):
            break
        own = np.argmax(data @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def with_cell(rows: DataFrame, centroids: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """``rows`` with ``cell``, the centroid of largest inner product (of ties the first); -1 for a null vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(vector_col)).to_pylist()
            cell = np.full(len(own), -1, dtype=np.int32)
            at = [i for i, v in enumerate(own) if v is not None]
            if at:
                cell[at] = np.argmax(np.array([own[i] for i in at], dtype=np.float64) @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    kept = rows.drop("cell")
    return kept.mapInArrow(assign, StructType([*kept.schema.fields, StructField("cell", IntegerType())]))


class CellIndex:
    """Vectors of a store's table ``<name>_cells`` in buckets of their cell, and the centroids in ``<name>_centroids``."""

    def __init__(self, store, name: str, buckets: int = 64, vector_col: str = "embedding", id_col: str = "chunk_id"):
        self.store, self.name, self.buckets, self.vector_col, self.id_col = store, name, buckets, vector_col, id_col

    def build(self, rows: DataFrame, centroids: np.ndarray) -> None:
        spark = self.store.spark
        with self.store.transaction():
            self.store.write(f"{self.name}_centroids", spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cell int, centroid array<double>"))
            self.store.write(f"{self.name}_cells", with_cell(rows, centroids, self.vector_col), ["cell"], self.buckets)

    def _centroids(self) -> np.ndarray:
        found = sorted((r["cell"], r["centroid"]) for r in self.store.read(f"{self.name}_centroids").collect())  # as many as cells
        return np.array([c for _, c in found], dtype=np.float64)

    def add(self, rows: DataFrame) -> None:
        """Rows more, or rows again: those of their ids go from every cell, and only touched cells are written anew."""
        fresh, table = with_cell(rows, self._centroids(), self.vector_col), f"{self.name}_cells"
        old = self.store.read(table).select(self.id_col, "cell").join(rows.select(self.id_col).distinct(), self.id_col, "left_semi")
        gone = rows.select(self.id_col).distinct()
        self.store.rewrite(table, fresh.select("cell").union(old.select("cell")), lambda was: was.join(gone, self.id_col, "left_anti").unionByName(fresh))

    def nearest_cells(self, vector: Sequence[float], probes: int) -> list[int]:
        scores = self._centroids() @ np.asarray(vector, dtype=np.float64)
        return np.argsort(-scores, kind="stable")[:probes].tolist()

    def search(self, vector: Sequence[float], k: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """The k best rows of the ``probes`` nearest cells, with their exact scores."""
        cells = self.nearest_cells(vector, probes)
        buckets = sorted({zlib.crc32(str(c).encode()) % self.buckets for c in cells})
        rows = self.store.read(f"{self.name}_cells", buckets).filter(F.col("cell").isin(*cells))
        return vectors.search(rows, vector, k, where, self.id_col, self.vector_col)
