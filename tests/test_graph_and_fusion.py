import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fusion, graph, templates, vectors
from lumenfold.plans.answer import check

FACT = "subject_id string, predicate string, object_id string, hops int, confidence double, chunk_ids array<string>, sources array<string>, evidence string, template string, seq int, relevance double"


def facts(spark, *rows):
    return spark.createDataFrame([(s, p, o, h, c, ch, [], None, "t", i, r) for i, (s, p, o, h, c, ch, r) in enumerate(rows)], FACT)


def ranks(spark, ids):
    return spark.createDataFrame([(c, i) for i, c in enumerate(ids, 1)], "chunk_id string, rank int")


def test_fusion_of_two_lists(spark):
    out = fusion.reciprocal_rank_fusion(ranks(spark, ["a", "b"]), ranks(spark, ["c", "b"])).orderBy("fused_rank")
    assert [r["chunk_id"] for r in out.collect()] == ["b", "a", "c"]


def test_mentions_boost(spark):
    mentions = spark.createDataFrame([("b", 2)], "chunk_id string, n long")
    out = fusion.reciprocal_rank_fusion(ranks(spark, ["a", "b"]), ranks(spark, []), mentions).orderBy("fused_rank")
    assert [r["chunk_id"] for r in out.collect()] == ["b", "a"]


def test_facts_are_merged(spark):
    row = fusion.dedupe_facts(facts(spark, ("a", "P", "b", 2, 0.5, ["c1"], None), ("a", "P", "b", 1, 0.9, ["c2", "c1"], None))).first()
    assert (row["chunk_ids"], row["hops"], row["confidence"]) == (["c1", "c2"], 1, 0.9)


def test_hops_cost_relevance(spark):
    out = fusion.rank_facts(facts(spark, ("a", "P", "b", 2, 0.9, ["c"], 0.53), ("a", "P", "c", 1, 0.9, ["c"], 0.50))).orderBy("rank")
    assert [r["object_id"] for r in out.collect()] == ["c", "b"]


def test_asked_relation_is_boosted_along_a_chain(spark):
    rows = facts(spark, ("x", "SUBSIDIARY_OF", "y", 1, 0.9, ["c"], 0.6), ("p", "LEADS", "x", 2, 0.9, ["c"], 0.2), ("q", "LEADS", "z", 1, 0.9, ["c"], 0.3))
    out = fusion.rank_facts(rows, "LEADS").orderBy("rank")
    assert [(r["subject_id"], r["score"]) for r in out.collect()] == [("p", 0.65), ("x", 0.6), ("q", 0.5)]


def test_chunk_order(spark):
    rows = spark.createDataFrame([(1, ["c2"]), (2, ["c1", "c2"])], "rank int, chunk_ids array<string>")
    assert [r["chunk_id"] for r in fusion.chunk_order(rows).orderBy("pos").collect()] == ["c2", "c1"]


def test_budget_stops_at_facts_and_skips_chunks(spark):
    asked = [([400] * 5, [], 1000), ([900, 50], [300, 10], 1000), ([990, 50], [], 1000), ([], [1, 2, 500, 1], 100), (None, None, 9)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "q int, chunks array<int>, facts array<int>, budget int")
    got = rows.select("q", fusion.within_budget(F.col("chunks"), F.col("facts"), F.col("budget")).alias("fit")).orderBy("q").select("fit.*").collect()
    assert [tuple(r) for r in got] == [([], [0, 1], 824), ([], [0, 1], 974), ([], [1], 62), ([0, 1], [], 11), ([], [], 0)]


@pytest.mark.parametrize(
    ("ids", "kind", "hops", "want"),
    [([], "lookup", 2, []), (["a"], "lookup", 1, ["neighbourhood"]), (["a"], "relationship", 1, ["neighbourhood", "two_hop"]), (["a", "b"], "aggregation", 2, ["neighbourhood", "two_hop", "path", "intersection", "aggregation"])],
)
def test_template_choice(ids, kind, hops, want):
    assert templates.choose_templates(ids, kind, hops) == want


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("a", "P", "m", 1, 0.9), ("m", "P", "b", 2, 0.8), ("a", "P", "m", 3, 0.7), ("b", "Q", "h", 4, 0.6), ("h", "Q", "x", 5, 0.5), ("h", "Q", "y", 6, 0.5), ("h", "Q", "z", 7, 0.5), ("c", "P", "h", 8, 0.4)]
    return spark.createDataFrame(rows, "subject_id string, predicate string, object_id string, chunk_id long, confidence double")


def test_two_hops_spare_hubs_and_used_relations(spark, toy):
    got = {(r["subject_id"], r["object_id"], r["chunk_id"]) for r in templates.two_hop(toy, ["a"], hub=3).collect()}
    assert got == {("m", "b", 2)}
    assert templates.two_hop(toy, ["c"], hub=3).count() == 0


def test_shortest_paths(spark, toy):
    got = [(r["a"], r["b"], r["hops"], r["nodes"]) for r in templates.shortest_paths(toy, ["a", "b", "h"], hub=10).collect()]
    assert got == [("a", "b", 2, ["a", "m", "b"]), ("a", "h", 3, ["a", "m", "b", "h"]), ("b", "h", 1, ["b", "h"])]


def test_intersection_needs_all_seeds(spark, toy):
    assert {r["chunk_id"] for r in templates.intersection(toy, ["a", "b"]).collect()} == {1, 2, 3}
    assert templates.intersection(toy, ["a", "c"]).count() == 0


def test_replacing_a_source_leaves_no_stale_rows(spark):
    old = spark.createDataFrame([("c1", "s"), ("c2", "s"), ("c3", "t")], "chunk_id string, source string")
    new = spark.createDataFrame([("c2", "s"), ("c4", "s")], "chunk_id string, source string")
    after, stale = graph.replace_source(old, new, "s")
    assert {r["chunk_id"] for r in after.collect()} == {"c2", "c3", "c4"} and [r["chunk_id"] for r in stale.collect()] == ["c1"]
    again, stale = graph.replace_source(after, new, "s")
    assert again.count() == 3 and stale.count() == 0


def test_entities_merge(spark):
    schema = "id string, name string, type string, labels array<string>, aliases array<string>"
    old = spark.createDataFrame([("e", "First", "Person", ["Person"], ["x", "y"])], schema)
    new = spark.createDataFrame([("e", "Second", "Concept", [], ["y", "z"]), ("f", "New", "Event", [], [])], schema)
    got = {r["id"]: r for r in graph.merge_entities(old, new).collect()}
    assert (got["e"]["name"], got["e"]["type"], got["e"]["labels"], got["e"]["aliases"]) == ("First", "Concept", ["Person", "Concept"], ["x", "y", "z"])
    assert got["f"]["name"] == "New"


def test_grouped_search_limits_before_the_threshold(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [0.6, 0.8]), (4, "d", [0.8, 0.6]), (5, "e", [0.95, 0.3122])], "chunk_id int, doc_id string, embedding array<float>")
    one = vectors.centroids(rows.filter("doc_id = 'a'"))
    got = vectors.best_in_groups(rows, one, limit=2, threshold=0.97).collect()
    assert [r["doc_id"] for r in got] == ["b"]


def test_evidence(spark):
    scores = spark.createDataFrame([(-8.0, 0.001)], "rerank double, relevance double")
    assert fusion.has_evidence(scores).first()["evidence"] is False
    assert fusion.has_evidence(scores, aggregates=True).first()["evidence"] is True
    empty = spark.createDataFrame([], "rerank double, relevance double")
    assert fusion.has_evidence(empty).first()["evidence"] is False


def test_answers_are_checked(spark):
    got = check("Leads the north zone of the company [G1][C7]. Founded long before any of the others were. More [C1].", {"G1", "C1"})
    assert (got.used, got.invalid, got.uncited) == (["G1", "C1"], ["C7"], ["Founded long before any of the others were."])


def test_all_facets_from_one_plan(spark):
    """Twelve kinds of linked vertices and five columns at once, the same as one by one."""
    import random

    from lumenfold.plans.lexicon import NODE_FACETS, PROPERTY_FACETS

    r = random.Random(6)
    rows = [(f"p{i:02}", *[r.choice(["a", "b", "c", None]) for _ in PROPERTY_FACETS]) for i in range(60)]
    posts = spark.createDataFrame(rows, "post_id string, " + ", ".join(f"{c} string" for c in PROPERTY_FACETS))
    vertices = spark.createDataFrame([(f"{d}{i}", label, f"name {i % 3}", kind) for d, (label, _, kind) in NODE_FACETS.items() for i in range(5)], "id string, label string, name string, kind string")
    edges = spark.createDataFrame([(p[0], f"{d}{r.randrange(5)}", rel, None) for p in rows for d, (_, rel, _) in NODE_FACETS.items() for _ in range(r.randrange(3))], "src string, dst string, rel string, stance string")
    seeds, where = ["person1", "topic2"], F.col("sentiment") == "a"
    got = templates.facets(posts, edges, vertices, NODE_FACETS, PROPERTY_FACETS, where, seeds, 3).collect()
    by = lambda dim: [(x["id"], x["name"], x["n"], x["sample_min"], x["sample_max"]) for x in sorted(got, key=lambda x: x["place"]) if x["dim"] == dim]
    assert [x[2] for x in by("total")] == [templates.total(posts, edges, where, seeds).first()["n"]]
    for dim, (label, rel, kind) in NODE_FACETS.items():
        want = templates.facet_nodes(posts, edges, vertices.filter(F.col("label") == label), rel, kind, where, seeds, 3).collect()
        assert by(dim) == [tuple(x) for x in want]
    for c in PROPERTY_FACETS:
        assert [x[1:] for x in by(c)] == [tuple(x) for x in templates.facet_property(posts, edges, c, where, seeds, 3).collect()]
    alone = templates.facets(posts, edges, vertices, {}, [], F.lit(False)).collect()
    assert [(x["dim"], x["n"]) for x in alone] == [("total", 0)]


def test_equal_facts_are_ranked_by_many_tasks(spark, monkeypatch):
    """All facts have the same hops and confidence: no task may have to sort them all to number them."""
    kept = {}
    monkeypatch.setattr(fusion, "TASK_ROWS", 100)
    monkeypatch.setattr(fusion, "written", lambda df, name, make=fusion.written: kept.setdefault(name, make(df, name)))
    rows = [(f"s{i % 37}", "SUPPLIES", f"p{i}", 1, 0.5, [i], 0.25) for i in range(2000)]
    facts = spark.createDataFrame(rows, "subject_id string, predicate string, object_id string, hops int, confidence double, chunk_ids array<int>, relevance double")
    want = [(s, o, n) for n, (s, o) in enumerate(sorted((r[0], r[2]) for r in rows), 1)]
    for rank in (fusion.rank_facts_unscored, fusion.rank_facts):
        kept.clear()
        assert [tuple(r) for r in rank(facts).orderBy("rank").select("subject_id", "object_id", "rank").collect()] == want
        held = [r["n"] for r in kept["numbered"].groupBy((F.col("__at") / 2**33).cast("long")).agg(F.count("*").alias("n")).collect()]
        assert len(held) > 10 and max(held) < 400
