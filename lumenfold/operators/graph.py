"""Vertex and edge tables: building, merging, replacing by source, collecting what nothing refers to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_source(old: DataFrame, new: DataFrame, source: str, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """The table after a source's rows are replaced by new ones, and the old rows that are gone for good."""
    ids = new.select(id_col).distinct()
    stale = old.filter(F.col("source") == source).join(ids, id_col, "left_anti")
    kept = old.filter(~F.col("source").eqNullSafe(source)).join(ids, id_col, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), stale


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` instead of those of ``old`` with the same key; columns that either lacks are null."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def next_edges(chunks: DataFrame) -> DataFrame:
    """src -> dst for each two neighbouring chunks of a document."""
    after = F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.select(F.col("chunk_id").alias("src"), after.alias("dst")).filter("dst IS NOT NULL")


def part_of_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("src"), F.col("doc_id").alias("dst"), F.lit("PART_OF").alias("rel")).distinct()


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (id, name, type, labels, aliases) after a merge: the first name stays, the newest type holds, labels pile up,
    and new aliases follow those old ones that aren't among them."""
    n = new.select("id", F.col("name").alias("n_name"), F.col("type").alias("n_type"), F.col("aliases").alias("n_aliases"))
    both = old.join(n, "id", "full_outer")
    none = F.array().cast("array<string>")
    aliases = F.concat(F.array_except(F.coalesce("aliases", none), F.coalesce("n_aliases", none)), F.coalesce("n_aliases", none))
    labels = F.array_distinct(F.concat(F.coalesce("labels", none), F.when(F.col("n_type").isNotNull(), F.array("n_type")).otherwise(none)))
    return both.select("id", F.coalesce("name", "n_name").alias("name"), F.coalesce("n_type", "type").alias("type"), labels.alias("labels"), aliases.alias("aliases"))


def merge_relations(old: DataFrame, new: DataFrame, seq_col: str = "seq") -> DataFrame:
    """One relation for each (subject, object, predicate, chunk): the last written."""
    keys = ["subject_id", "object_id", "predicate", "chunk_id"]
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), seq_col).alias("r")).select(*keys, "r.*").drop(seq_col)
    return upsert(old, last, keys)


def collect_garbage(entities: DataFrame, relations: DataFrame, mentions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that some chunk mentions, and relations whose chunk is there."""
    live = mentions.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    kept = entities.join(live.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    return kept, relations.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")


def similar_edges(pairs: DataFrame) -> DataFrame:
    """Undirected similarity: one edge a pair, the higher score."""
    return pairs.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def orphans(nodes: DataFrame, referred: DataFrame, id_col: str = "id") -> DataFrame:
    """Nodes that nothing refers to."""
    return nodes.join(referred.select(id_col).distinct(), id_col, "left_anti")


def known_entities(entities: DataFrame, mentions: DataFrame, limit: int | None = 100) -> DataFrame:
    """Entities by mentions, those without any included. Mentions are counted before the join."""
    counts = mentions.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    out = entities.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out if limit is None else out.orderBy(F.desc("n"), "name", "id").limit(limit)


def store_counts(vertices: DataFrame, edges: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """Vertices by label (every asked label, at zero too) and edges by relation."""
    nodes = vertices.groupBy("label").agg(F.count("*").alias("n"))
    if labels:
        asked = vertices.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        nodes = asked.join(nodes, "label", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    links = edges.groupBy(F.col("rel").alias("label")).agg(F.count("*").alias("n"))
    return nodes.select(F.lit("node").alias("what"), "label", "n").unionAll(links.select(F.lit("edge").alias("what"), "label", "n"))


def name_index(vertices: DataFrame, edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every nameable vertex with the posts that link to it."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("posts"))
    own = vertices.filter(F.col("label").isin(*labels))
    return own.join(counts, "id", "left").withColumn("posts", F.coalesce("posts", F.lit(0).cast("long")))


def document_sources(documents: DataFrame, limit: int = 1000) -> DataFrame:
    return documents.select("source", "doc_type").distinct().orderBy("source").limit(limit)


def chunks_matching(chunks: DataFrame, where) -> DataFrame:
    return chunks.filter(where).select("chunk_id")


def entities_in_chunks(mentions: DataFrame, relations: DataFrame, ranked_chunks: DataFrame, hub: int = 50) -> DataFrame:
    """Entities of ranked chunks (chunk_id, chunk_rank) that have relations and are no hubs: entity_id, chunk_rank."""
    from lumenfold.operators.templates import degrees

    near = mentions.join(ranked_chunks, "chunk_id").select("entity_id", "chunk_rank").distinct()
    calm = degrees(relations, near.select(F.col("entity_id").alias("id"))).filter(F.col("degree") <= hub).select(F.col("id").alias("entity_id"))
    return near.join(calm, "entity_id", "left_semi")
