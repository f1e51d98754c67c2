"""Entities over documents, broken extractions, components: against direct versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.components import components
from lumenfold.operators.extraction import KNOWN, entity_key, extract_graph, read_extractions
from lumenfold.operators.vectors import HashedEmbedder
from lumenfold.plans.ingest import Store, ingest_documents
from lumenfold.sources import files

SCHEMA = "doc_id string, chunk_index int, chunk_id string, text string, extraction string"


def chunk(doc, index, text, entities, triples=()):
    said = {"entities": [{"name": n, "type": t, "aliases": list(a)} for n, t, *a in entities], "triples": [dict(zip(("subject", "predicate", "object", "evidence"), t, strict=True), confidence=0.9) for t in triples]}
    return doc, index, f"{doc}-{index}", text, json.dumps(said)


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(150):03}", f"n{r.randrange(150):03}") for _ in range(90)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("hub", f"h{i}") for i in range(30)] + [("x", "x")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == union_find(pairs)


def direct(rows, stored):
    """Entities as id -> (name, aliases), by a union over keys of one type; seeds first."""
    said = sorted((doc, index, cid, pos, e["name"].strip(), e["type"], [a.strip() for a in e["aliases"]]) for doc, index, cid, _, x in rows for pos, e in enumerate(json.loads(x)["entities"]))
    owner = {}
    for i, name, kind, aliases in stored:
        for s in (name, *aliases):
            owner.setdefault((kind, entity_key(s, kind)), []).append(i)
    keys = lambda e: [(e[5], entity_key(s, e[5])) for s in dict.fromkeys([e[4], *e[6]])]
    root = union_find([(keys(e)[0], k) for e in said for k in keys(e)])
    own = [next((min(owner[k]) for k in keys(e) if k in owner), None) for e in said]
    seed, first = {}, {}
    for e, o in zip(said, own, strict=True):
        k = root[keys(e)[0]]
        seed[k] = min(filter(None, (seed.get(k), o)), default=None)
        first.setdefault(k, e)
    out = {}
    for e, o in zip(said, own, strict=True):
        k = root[keys(e)[0]]
        prefix = {"Person": "person", "Organization": "org", "Location": "loc"}[e[5]]
        i = o or seed[k] or f"{prefix}:{entity_key(first[k][4], e[5])}"
        out.setdefault(i, []).extend(s for s in [e[4], *e[6]] if s not in out.get(i, []))
    return {i: (s[0], [x for x in dict.fromkeys(s) if x != s[0]]) for i, s in out.items()}


STORED = [("org:old_mills", "Old Mills", "Organization", ["Mills of Old"]), ("org:west_line", "West Line", "Organization", []), ("person:asha", "Asha", "Person", ["Asha R"])]


@pytest.mark.parametrize("parts", [1, 5])
def test_entities_over_documents(spark, parts):
    r = random.Random(4)
    names = [f"{a} {b}" for a in ("North", "South", "East") for b in ("Works", "Works Ltd", "Yards", "यार्ड")] + ["Old Mills Pvt Ltd", "West Line", "Mills of Old"]
    people = ["Asha", "ASHA  R", "Bela", "Bela K"]
    rows = []
    for d in range(12):
        for i in range(3):
            listed = [(r.choice(names), "Organization", *(r.sample(names, 1) if r.random() < 0.2 else ())) for _ in range(2)] + [(r.choice(people), "Person")] + [("North", "Location")]
            rows.append(chunk(f"d{d:02}", i, "text", listed))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts, "chunk_id")
    got = extract_graph(frame, spark.createDataFrame(STORED, KNOWN))
    assert {e["id"]: (e["name"], e["aliases"]) for e in got.entities.collect()} == direct(rows, STORED)
    assert got.mentions.filter("entity_id = 'org:old_mills'").count() > 0


def test_a_bridge_joins_no_stored_entities(spark):
    rows = [chunk("a", 0, "", [("Old Mills", "Organization", "West Line")]), chunk("b", 0, "", [("West Line Ltd", "Organization")]), chunk("b", 1, "", [("North", "Person"), ("North", "Location")])]
    got = extract_graph(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(STORED, KNOWN))
    assert {tuple(m) for m in got.mentions.collect()} == {("a-0", "org:old_mills"), ("b-0", "org:west_line"), ("b-1", "person:north"), ("b-1", "loc:north")}


def test_ends_of_triples(spark):
    text = "Asha R. founded Delta Looms (Pvt) in Pune with 42nd Street Traders and someone."
    triples = [("Asha R (founder)", "leads", "Delta Looms", "Asha R. founded"), ("Pune", "located in", "Delta Looms", "Delta Looms (Pvt) in Pune"), ("42nd Street Traders", "supplies", "Delta Looms", "with 42nd Street"), ("someone", "owns", "Delta Looms", "and someone"), ("Mumbai", "owns", "Delta Looms", "founded Delta"), ("Delta Looms Ltd", "owns", "Delta Looms", "founded Delta")]
    rows = [chunk("a", 0, text, [("Delta Looms", "Organization"), ("Asha R", "Person"), ("Pune", "Location")], triples), ("a", 1, "a-1", "x", None), ("a", 2, "a-2", "x", "{no json")]
    got = extract_graph(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(STORED, KNOWN))
    assert {(r["subject_id"], r["predicate"], r["object_id"], r["original_predicate"]) for r in got.relations.collect()} == {("person:asha", "LEADS", "org:delta_looms", None), ("org:delta_looms", "LOCATED_IN", "loc:pune", None), ("concept:42nd_street_traders", "SUPPLIES", "org:delta_looms", None)}
    assert [tuple(r) for r in got.dropped.collect()] == [("a-0", 3)]
    assert got.entities.filter("id = 'concept:42nd_street_traders'").first()["name"] == "42nd Street Traders"


def test_broken_extractions_are_known(spark):
    good = json.dumps({"entities": [], "triples": []})
    rows = [("a", i, f"a-{i}", "", x) for i, x in enumerate([good, None, "", "[1]", '{"entities": 3}', '{"triples": []}', '{"entities": [{"name": "x", "type": "Person"}]}'])]
    assert [r["broken"] for r in read_extractions(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk_index").collect()] == [False, True, True, True, True, True, False]


def test_only_broken_answers_are_asked_for_again(spark, tmp_path):
    folder, asked = tmp_path / "docs", tmp_path / "asked"
    folder.mkdir()
    asked.mkdir()
    for name in ("fine", "once", "twice"):
        (folder / f"{name}.txt").write_text(f"Tara Mills owns the {name} loom.", encoding="utf-8")

    def extract(text):
        name = next(n for n in ("fine", "once", "twice") if n in text)
        (asked / f"{name}-{len(list(asked.glob(name + '-*')))}").write_text("")
        if name == "twice" or name == "once" and len(list(asked.glob("once-*"))) == 1:
            return "Sure! Here is the JSON you asked for"
        return json.dumps({"entities": [{"name": "Tara Mills", "type": "Organization", "aliases": []}], "triples": []})

    store = Store(spark, f"file://{tmp_path}/store")
    report = ingest_documents(store, files.load_files(spark, str(folder)), HashedEmbedder(16), extract)
    assert report.extractions == {"asked_again": 2, "failed": 1} and report.counts["mentions"] == 2
    assert sorted(p.name for p in asked.iterdir()) == ["fine-0", "once-0", "once-1", "twice-0", "twice-1"]


def test_a_name_from_another_document_is_one_entity(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_text("Shakti Steel Works, called SSW, opened.", encoding="utf-8")

    def extract(text):
        listed = [{"name": "Shakti Steel Works", "type": "Organization", "aliases": ["SSW"]}] if "Shakti" in text else [{"name": "SSW", "type": "Organization", "aliases": []}]
        return json.dumps({"entities": listed, "triples": []})

    store, embed = Store(spark, f"file://{tmp_path}/store"), HashedEmbedder(16)
    ingest_documents(store, files.load_files(spark, str(folder)), embed, extract)
    (folder / "a.txt").rename(tmp_path / "a.txt")
    (folder / "b.txt").write_text("SSW hired many.", encoding="utf-8")
    ingest_documents(store, files.load_files(spark, str(folder)), embed, extract)
    assert {r["entity_id"] for r in store.read("mentions").collect()} == {"org:shakti_steel_works"} and store.read("mentions").count() == 2
    assert store.read("entities").select("id", F.size("aliases")).collect() == [("org:shakti_steel_works", 1)]
