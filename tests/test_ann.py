"""Cells of vectors: recall against exact search, what is read, updates."""

from pathlib import Path

import numpy as np
import pytest

from lumenfold.operators.ann import CellIndex, fit_centroids, with_cell
from lumenfold.operators.vectors import search
from lumenfold.plans.store import Store

SCHEMA = "chunk_id long, embedding array<double>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(n, groups=40, dim=24, seed=1):
    rnd = np.random.default_rng(seed)
    return unit(unit(rnd.normal(size=(groups, dim)))[rnd.integers(0, groups, n)] + rnd.normal(scale=0.12, size=(n, dim)))


def build(spark, tmp_path, data, cells, id_col="chunk_id"):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], SCHEMA.replace("chunk_id", id_col)).repartition(4).cache()
    index = CellIndex(Store(spark, f"file://{tmp_path}/s"), "v", cells, id_col=id_col)
    index.build(rows, fit_centroids(rows, cells, id_col=id_col))
    return rows, index


def measured(rows, index, data, asked, probes, k=20):
    recall, read, cells = [], [], np.argmax(data @ index._centroids().T, axis=1)
    for q in asked:
        exact = np.lexsort((np.arange(len(data)), -np.round(data @ data[q], 12)))[:k]
        got = [r["chunk_id"] for r in index.search(data[q].tolist(), k, probes).collect()]
        recall.append(len(set(got) & set(exact.tolist())) / k)
        read.append(np.isin(cells, index.nearest_cells(data[q], probes)).mean())
    return np.mean(recall), np.mean(read)


def test_recall_on_clustered_vectors(spark, tmp_path):
    data = clustered(3000)
    rows, index = build(spark, tmp_path, data, 48)
    recall, read = measured(rows, index, data, range(0, 3000, 250), 8)
    assert recall >= 0.95 and read <= 0.35
    few = index.search(data[5].tolist(), 5, 3)
    assert len(few.inputFiles()) < len(rows.sparkSession.read.parquet(*index.store.parts("v_cells").values()).inputFiles())
    every = [(r["chunk_id"], round(r["score"], 9)) for r in index.search(data[7].tolist(), 10, 48).collect()]
    assert every == [(r["chunk_id"], round(r["score"], 9)) for r in search(rows, data[7].tolist(), 10).collect()]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables here")
def test_recall_on_the_tables_vectors(spark, tmp_path):
    """Vectors without clusters: recall of 0.95 takes most of the cells."""
    data = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("embedding IS NOT NULL").orderBy("vec_id").collect()], dtype=np.float64)
    rows, index = build(spark, tmp_path, data, 32)
    recall, read = measured(rows, index, data, range(0, len(data), len(data) // 10), 24)
    assert recall >= 0.95 and read <= 0.85


def test_updates_and_odd_rows(spark, tmp_path):
    data = clustered(200)
    rows, index = build(spark, tmp_path, data, 8)
    moved = (-data[3]).tolist()
    index.add(spark.createDataFrame([(3, moved), (999, data[4].tolist()), (1000, None)], SCHEMA))
    assert [r["chunk_id"] for r in index.search(moved, 1, 8).collect()] == [3]
    assert {r["chunk_id"] for r in index.search(data[4].tolist(), 2, 8).collect()} == {4, 999}
    assert index.store.read("v_cells").count() == 202 and index.store.read("v_cells").filter("cell = -1").count() == 1
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], SCHEMA)
    assert len(fit_centroids(same, 4)) == 1 and len(fit_centroids(same.limit(0), 4)) == 0
    assert {r["cell"] for r in with_cell(same, np.array([[1.0, 0.0], [1.0, 0.0]])).collect()} == {0}
