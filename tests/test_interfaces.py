import pytest
from pyspark.sql import functions as F

from lumenfold.functions import filters
from lumenfold.operators import fulltext
from lumenfold.operators.extraction import entity_key
from lumenfold.plans import evalkit
from lumenfold.plans.api import Cache, Engine, valid_metadata
from lumenfold.plans.ingest import Store
from lumenfold.plans.retrieve import Result
from lumenfold.schemas import VERTICES, assert_schema
from lumenfold.sources import files


def test_engine_over_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "report.md").write_text("# Annual report\nThe bridge at Kanpur opened in March 2024.\n## Staff\nAsha leads the bridge team.\n", encoding="utf-8")
    (folder / "note.txt").write_text("Nothing about bridges here, only canals.", encoding="utf-8")
    engine = Engine(Store(spark, f"file://{tmp_path}/store"))
    assert engine.ingest(str(folder))["status"] == "completed" and engine.stats()["chunks"] == 3
    answer = engine.query("Who leads the bridge team?", mode="vector")
    assert answer.grounded and "Asha" in answer.answer and answer.citations[0] == "C1" and not answer.invalid
    assert engine.retrieve("canals", mode="vector", filters={"source": "note.txt"}).chunks[0]["source"] == "note.txt"
    assert engine.health() == {"spark": True, "docs": True, "sql": False} and [j["kind"] for j in engine.jobs()] == ["documents"]
    with pytest.raises(ValueError, match="signs"):
        engine.retrieve("x")
    (folder / "bad.exe").write_bytes(b"x")
    with pytest.raises(Exception, match="unsupported"):
        engine.ingest(str(folder))
    assert {j["status"] for j in engine.jobs()} == {"completed", "failed"}


def test_cache_computes_misses_once(spark, tmp_path):
    cache, asked = Cache(Store(spark, f"file://{tmp_path}/c")), []

    def slow(rows):
        asked.append(rows.count())
        return rows.withColumn("value", F.upper("a"))

    rows = spark.createDataFrame([("x", "1"), ("y", None), ("x", "1")], "a string, b string")
    for _ in range(2):
        assert sorted(r["value"] for r in cache.through(rows, ["a", "b"], slow).collect()) == ["X", "X", "Y"]
    assert asked == [2, 0]


def test_metadata():
    assert valid_metadata('{"a": 1, "b": "x", "c": true}') == {"a": 1, "b": "x", "c": True} and valid_metadata(None) == {}
    for bad in ("[1]", '{"a": [1]}', '{"a": null}'):
        with pytest.raises(ValueError, match="object"):
            valid_metadata(bad)


def test_evaluation(spark):
    found = lambda q, mode: Result(q, mode, None, [{"text": "Asha leads the team"}] if mode != "graph" else [])
    rows = evalkit.evaluate(spark, [{"id": "q1", "question": "who", "reference": "Asha leads"}, {"id": "q2", "question": "x", "reference": ""}], found)
    got = {r["mode"]: (r["recall"], r["n"], r["answered"]) for r in evalkit.summary(rows).collect()}
    assert got == {"vector": (1.0, 1, 2), "graph": (0.0, 1, 0), "hybrid": (1.0, 1, 2)}
    timings = spark.createDataFrame([("search", 1.5), ("rank", 2.0), ("odd", 1.0)], "name string, ms double")
    assert {r["stage"]: r["ms"] for r in evalkit.stage_totals(timings, {"search": "find", "rank": "find"}).collect()} == {"find": 3.5, "other": 1.0}


def test_pages_and_images(spark):
    pages = spark.createDataFrame([("x" * 60, ["Arial"]), ("short", []), ("y" * 60, ["KrutiDev010"]), (None, None)], "text string, fonts array<string>")
    assert [r["route"] for r in files.routed(pages).collect()] == ["text", "ocr", "ocr", "ocr"]
    words = spark.createDataFrame([(1, 0, 0, 0, 0, "a", 90.0), (1, 0, 0, 0, 1, "b", 80.0), (1, 0, 0, 1, 0, "c", 70.0), (1, 0, 0, 1, 1, "bad", 20.0)], "page int, block int, par int, line int, pos int, word string, conf double")
    assert [(r["text"], r["confidence"]) for r in files.ocr_lines(words).collect()] == [("a b\nc", 80.0)]
    images = spark.createDataFrame([("d", 2, b"i", 200, 200), ("d", 1, b"i", 200, 200), ("d", 1, b"j", 20, 200)], "doc_id string, page int, content binary, width int, height int")
    assert [(r["page"], bytes(r["content"])) for r in files.distinct_images(images).collect()] == [(1, b"i")]
    uploads = spark.createDataFrame([("a.pdf", b"%PDF-1.7"), ("b.pdf", b"x"), ("c.txt", b"")], "path string, content binary")
    assert {r["path"]: r["problem"] for r in files.problems(uploads).collect()} == {"b.pdf": "not a PDF", "c.txt": "empty"}


def test_filters_are_given_up_in_order(spark):
    assert filters.levels(["district", "platform", "time"]) == [["district", "platform", "time"], ["district", "platform"], ["district"], []]
    assert filters.levels(["district", "platform"], fixed=frozenset({"district"})) == [["district", "platform"], ["district"]]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    assert filters.first_that_matches(rows, {"platform": F.col("x") == "z", "district": F.col("y") == 1}, filters.levels(["district", "platform"])) == ["district"]


def test_names_resolve_to_one_entity(spark):
    rows = [("org:shakti", "Shakti Steel", "Organization", "Shakti Steel Shakti"), ("org:ganga", "Ganga Roadways", "Organization", "Ganga Roadways"), ("loc:ganga", "Ganga River", "Location", "Ganga River")]
    entities = spark.createDataFrame(rows, "id string, name string, type string, names string")
    find = lambda name: (hit := fulltext.resolve(entities, name, entity_key)) and hit["id"]
    assert find("Ganga Roadways Ltd") == "org:ganga" and find("shakti steel") == "org:shakti" and find("Ganga") is None and find("") is None and find("unknown") is None


def test_schema_contract(spark):
    good = spark.createDataFrame([], VERTICES)
    assert assert_schema(good.withColumn("more", F.lit(1)), VERTICES).columns == VERTICES.fieldNames()
    with pytest.raises(ValueError, match="kind"):
        assert_schema(good.drop("kind"), VERTICES)
