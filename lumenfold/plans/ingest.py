"""Ingest of documents and dumps into stored tables. All tables of one ingest become visible together; an ingest that fails
leaves the ones before it, and a second run of the same input ends with the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import normalize_text
from lumenfold.operators import chunking, extraction, fulltext, graph, posts, vectors
from lumenfold.plans.store import Store
from lumenfold.settings import Settings
from lumenfold.sources.gazetteer import district_table
from lumenfold.sources.mysqldump import one_table, read_dump


@dataclass
class Report:
    """What an ingest did."""

    counts: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    kept_graphs: list[str] = field(default_factory=list)
    extractions: dict[str, int] = field(default_factory=dict)


def entity_index(store: Store) -> fulltext.StoredIndex:
    """The stored index of entity names and aliases; an entity is a source of its own."""
    return fulltext.StoredIndex(store, "entity_index")


def _tally(df: DataFrame, column: str) -> dict[str, int]:
    return {r[column]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}


def ingest_documents(store: Store, pages: DataFrame, embed: Callable[[str], list[float]], extract: Callable[[str], str] | None = None, settings: Settings | None = None) -> Report:
    """``_ingest_documents`` as one transaction."""
    with store.transaction():
        return _ingest_documents(store, pages, embed, extract, settings)


def _ingest_documents(store: Store, pages: DataFrame, embed: Callable[[str], list[float]], extract: Callable[[str], str] | None = None, settings: Settings | None = None) -> Report:
    """Pages to chunks, vectors and a graph: the chunks' documents and neighbours, similar documents and, with an extractor
    (chunk text -> JSON), entities and relations. Each source in ``pages`` replaces its earlier rows; relations of chunks
    that are gone go, and so do entities nothing mentions.

    Where the extractor fails (an error, no text, no JSON) on a chunk of a source that has a graph already, that graph stays
    as it is, with the chunks it was built from; the source is named in ``kept_graphs``."""
    s = settings or Settings()
    pages = pages.withColumn("text", normalize_text(F.col("text")))
    new = vectors.embedded(chunking.chunk_pages(pages, s.chunk_tokens, s.chunk_overlap), embed)
    old = store.read("chunks")
    sources = pages.select("source").distinct()
    if old is not None:
        kept = old.join(sources, "source", "left_anti").join(new.select("chunk_id"), "chunk_id", "left_anti")
        removed = old.join(sources, "source", "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti").count()
        new = kept.unionByName(new, allowMissingColumns=True)
    else:
        removed = 0
    chunks = store.write("chunks", new)
    report = Report({"chunks": chunks.count(), "removed": removed}, _tally(chunks, "language"))
    fresh = fresh_chunks = chunks.join(sources, "source", "left_semi")
    if extract is not None:

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            def one(text: str) -> str | None:
                try:
                    return extract(text)
                except Exception:  # noqa: BLE001  an extractor that fails is counted, the ingest goes on
                    return None

            return texts.map(one)

        # written at once: an extractor is asked about each chunk one time, and once more where its answer is broken
        asked = store.write("extractions", fresh.drop("embedding").withColumn("extraction", run("text")))
        first = extraction.read_extractions(asked)
        again = store.write("extractions_again", first.filter("broken").drop("said", "broken").withColumn("extraction", run("text")))
        second = extraction.read_extractions(again)
        fresh = first.filter("NOT broken").unionByName(second)
        tries = second.agg(F.count("*").alias("asked"), F.count_if("broken").alias("failed")).first()
        report.extractions = {"asked_again": tries["asked"], "failed": tries["failed"]}
    nodes = ["chunk_id", "doc_id", "source", "chunk_index"]
    old_nodes = store.read("graph_chunks")
    if extract is not None and old_nodes is not None:
        failed = fresh.filter("broken").select("source").distinct()
        kept_sources = failed.join(old_nodes.select("source").distinct(), "source", "left_semi")
        # a list of sources of one call, as its report
        report.kept_graphs = sorted(r["source"] for r in kept_sources.collect())
        fresh = fresh.join(kept_sources, "source", "left_anti")
        sources = sources.join(kept_sources, "source", "left_anti")
    live = fresh.select(*nodes) if old_nodes is None else old_nodes.join(sources, "source", "left_anti").join(fresh.select("chunk_id"), "chunk_id", "left_anti").union(fresh.select(*nodes))
    live = store.write("graph_chunks", live)
    store.write("chunk_edges", graph.part_of_edges(live).union(graph.next_edges(live).withColumn("rel", F.lit("NEXT"))))
    # only the documents of this call are compared anew; edges of documents that are gone go
    near = vectors.best_in_groups(chunks, vectors.centroids(fresh_chunks), limit=s.similar_limit, threshold=s.similar_threshold)
    edges, old_edges = near.select(F.col("source").alias("a"), F.col("doc_id").alias("b"), "score"), store.read("similar")
    if old_edges is not None:
        changed, there = fresh_chunks.select("doc_id").distinct(), live.select("doc_id").distinct()
        for end in ("a", "b"):
            at = lambda d, c=end: d.select(F.col("doc_id").alias(c))
            old_edges = old_edges.join(at(changed), end, "left_anti").join(at(there), end, "left_semi")
        edges = edges.unionByName(old_edges)
    store.write("similar", graph.similar_edges(edges))
    if extract is not None:
        old_e, old_r, old_m = store.read("entities"), store.read("relations"), store.read("mentions")
        found = extraction.extract_graph(fresh.filter("NOT broken"), old_e)
        relations, entities, mentions = store.write("extracted", found.relations), found.entities, found.mentions
        none = store.spark.createDataFrame([], "id string, name string, type string, labels array<string>, aliases array<string>")
        all_m = mentions if old_m is None else old_m.join(fresh.select("chunk_id"), "chunk_id", "left_anti").union(mentions)
        live_m = all_m.join(live.select("chunk_id"), "chunk_id", "left_semi")
        before = relations.drop("seq").limit(0) if old_r is None else old_r.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
        all_r = graph.merge_relations(before, relations)
        all_e, live_r = graph.collect_garbage(graph.merge_entities(none if old_e is None else old_e, entities), all_r, live_m, live)
        spelt = lambda e: e.select("id", F.col("id").alias("source"), F.concat_ws(" ", F.col("name"), F.array_join("aliases", " ")).alias("text"))
        all_e = store.write("entities", all_e)
        now, was = spelt(all_e), spelt(none if old_e is None else old_e)
        # only entities that are new, gone or called otherwise than before
        entity_index(store).replace(now.exceptAll(was), was.exceptAll(now).select("source"))
        report.counts |= {"relations": store.write("relations", live_r).count(), "entities": all_e.count(), "mentions": store.write("mentions", live_m).count(), "dropped": found.dropped.agg(F.coalesce(F.sum("dropped"), F.lit(0))).first()[0]}
    return report


def ingest_dump(store: Store, path: str, embed: Callable[[str], list[float]], settings: Settings | None = None, limit: int = 0) -> Report:
    """``_ingest_dump`` as one transaction."""
    with store.transaction():
        return _ingest_dump(store, path, embed, settings, limit)


def _ingest_dump(store: Store, path: str, embed: Callable[[str], list[float]], settings: Settings | None = None, limit: int = 0) -> Report:
    """A dump of analysed posts to posts, chunks with vectors, and the posts' graph. Posts are upserted: those that a newer
    dump lacks stay."""
    s, spark = settings or Settings(), store.spark
    dump = read_dump(spark, path, ["analyzed_data", "sentiment_entities", "thana_matrix", "broad_category", "sub_category", "keywords"]).cache()
    names = posts.gazetteer(district_table(spark))
    new, skipped = posts.normalize_posts(one_table(dump, "analyzed_data", list(posts.POST_COLUMNS)), names, s.post_chars, limit)
    stances, lost = posts.normalize_stances(one_table(dump, "sentiment_entities", ["analyzed_data_id", "entity_name", "stance", "confidence"]), new)
    stations, subs = posts.hierarchy(
        one_table(dump, "thana_matrix", ["district", "thana", "commissionarate", "dist_range", "zone"]), one_table(dump, "broad_category", ["id", "broad_category"]), one_table(dump, "sub_category", ["sub_category", "broad_category_id", "hint"]),
        one_table(dump, "keywords", ["sub_category_name", "hindi_keyword", "english_keyword", "hinglish_keyword"]), names,
    )
    all_posts, all_stances = store.upsert("posts", new, ["post_id"]), store.upsert("stances", stances, ["post_id"])
    # stations and categories pile up over dumps: one without their tables takes none away
    stations, subs = store.upsert("stations", stations, ["id"]), store.upsert("categories", subs, ["id"])
    vertices, edges = posts.post_graph(all_posts, all_stances)
    places = stations.select("id", F.lit("Thana").alias("label"), "name", F.col("district").alias("kind")).union(subs.select("id", F.lit("SubCategory").alias("label"), "name", F.lit(None).cast("string").alias("kind")))
    aliases = subs.select("id", "aliases").union(district_table(spark).groupBy(F.concat(F.lit("district:"), posts.key(F.col("name"))).alias("id")).agg(F.sort_array(F.collect_list("alias")).alias("aliases")))
    known = vertices.union(places.join(vertices, "id", "left_anti")).join(aliases, "id", "left")
    store.write("vertices", known)
    store.write("edges", edges.unionByName(posts.hierarchy_edges(stations, subs, all_posts), allowMissingColumns=True))
    store.write("post_chunks", vectors.embedded(posts.post_chunks(all_posts), embed))
    report = Report({"posts": all_posts.count(), "stances": all_stances.count(), "vertices": store.read("vertices").count(), "edges": store.read("edges").count()}, _tally(all_posts, "language"), {r["reason"]: r["n"] for r in skipped.union(lost).collect() if r["n"]})
    dump.unpersist()
    return report
