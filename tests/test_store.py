"""Snapshots and partial rewrites of stored tables."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenfold.plans.store import Store, bucket_of


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def content(df):
    return sorted(map(tuple, df.collect()))


def files(store, name):
    """Every data file of a table with its digest."""
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for folder in store.parts(name).values() for p in Path(folder.removeprefix("file://")).glob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def test_a_failed_table_leaves_all_old_ones(spark, store, tmp_path):
    with store.transaction():
        for t in "abc":
            store.write(t, frame(spark, [(1, "old")]))
    before = {str(p) for p in Path(tmp_path).rglob("*.parquet")}
    with pytest.raises(Exception, match="third"), store.transaction():
        store.write("a", frame(spark, [(2, "new")]))
        assert content(store.read("a")) == [(2, "new")] and content(Store(spark, store.folder).read("a")) == [(1, "old")]
        store.write("b", frame(spark, [(2, "new")]))
        store.write("c", frame(spark, [(2, "new")]).withColumn("v", F.raise_error(F.lit("third"))))
    assert [content(store.read(t)) for t in "abc"] == [[(1, "old")]] * 3
    assert {str(p) for p in Path(tmp_path).rglob("*.parquet")} == before


def test_a_reader_keeps_its_snapshot_through_two_ingests(spark, store):
    store.write("t", frame(spark, [(1, "first")]))
    held = store.snapshot().read("t")
    for v in ("second", "third"):
        store.write("t", frame(spark, [(1, v)]))
    assert content(held) == [(1, "first")] and content(store.read("t")) == [(1, "third")]
    store.write("t", frame(spark, [(1, "fourth")]))
    kept = list(Path(store.folder.removeprefix("file://")).glob("t/v-*"))
    assert len(kept) == 3 and len(list(Path(store.folder.removeprefix("file://")).glob("manifests/*.json"))) == 3


def test_an_upsert_writes_touched_buckets_alone(spark, store):
    store.upsert("t", frame(spark, [(i, "a") for i in range(200)]), ["k"], buckets=8)
    before, rows = files(store, "t"), frame(spark, [(7, "b"), (7000, "c")])
    touched = {str(r[0]) for r in rows.select(bucket_of(["k"], 8)).collect()}
    store.upsert("t", rows, ["k"])
    after = files(store, "t")
    same = {p for p in before if not any(f"__bucket={b}/" in p for b in touched)}
    assert same and {p: after[p] for p in same} == {p: before[p] for p in same} and len(set(after) - set(before)) == len(touched)
    want = sorted([(i, "a") for i in range(200) if i != 7] + [(7, "b"), (7000, "c")])
    assert content(store.read("t")) == want
    store.upsert("t", rows, ["k"])  # a batch that runs again
    assert content(store.read("t")) == want


def test_buckets_are_read_alone_and_columns_can_come(spark, store):
    store.upsert("t", frame(spark, [(i, "a") for i in range(50)]), ["k"], buckets=4)
    few = store.read("t", [2])
    assert 0 < few.count() < 50 and few.select(bucket_of(["k"], 4)).distinct().collect() == [(2,)]
    assert all("__bucket=2/" in f for f in few.inputFiles())
    store.upsert("t", spark.createDataFrame([(3, "b", 1.5)], "k int, v string, w double"), ["k"])
    got = {r["k"]: r["w"] for r in store.read("t").collect()}
    assert len(got) == 50 and got[3] == 1.5 and got[4] is None
    assert store.read("none") is None and not store.has("none")
    store.write("empty", frame(spark, []), ["k"])
    assert store.read("empty").columns == ["k", "v"] and store.read("empty").count() == 0


def test_a_second_dump_keeps_stations(spark, tmp_path):
    from lumenfold.operators.vectors import HashedEmbedder
    from lumenfold.plans.ingest import ingest_dump
    from test_posts_and_ingest import TABLES, statements

    store = Store(spark, f"file://{tmp_path}/store")
    seen = []
    for name, tables in (("a.sql", TABLES), ("b.sql", {k: v for k, v in TABLES.items() if k not in ("thana_matrix", "sub_category", "keywords")})):
        (tmp_path / name).write_text("".join(statements(tables)), encoding="utf-8")
        ingest_dump(store, f"file://{tmp_path}/{name}", HashedEmbedder(8))
        seen.append((content(store.read("stations").select("id", "name")), content(store.read("categories").select("id", "name")), content(store.read("edges").filter("src LIKE 'thana:%:civil_lines'").select("src", "dst"))))
    assert seen[0] == seen[1] and all(seen[0])
