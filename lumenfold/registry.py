"""The registered queries over the star-schema tables, each with the SQL that gives the same rows.

Orders stand for posts (their customer's nation is the district, the segment the category), line items for the links from
posts to parts and suppliers and for the evidence of supplier-part relations. Every query reads whole tables; ids and
limits are the question's parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import reachable
from lumenfold.functions import citations, dates, filters, text
from lumenfold.operators import ann, chunking, fulltext, fusion, graph, templates, vectors
from lumenfold.plans import evalkit, retrieve
from lumenfold.plans.store import Store
from lumenfold.scratch import scratch_dir
from lumenfold.sources import files, mysqldump

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------- the tables as posts and a graph ----------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("posted_at"), F.col("o_orderpriority").alias("platform"), F.col("o_orderstatus").alias("sentiment"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("district"),
        F.concat(F.lit("d"), F.col("n_nationkey")).alias("district_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("account_id"),
    )


POSTS = """posts AS (
  SELECT o_orderkey AS post_id, o_orderdate AS posted_at, o_orderpriority AS platform, o_orderstatus AS sentiment, c_mktsegment AS category,
         n_name AS district, 'd' || n_nationkey AS district_id, 'c' || c_custkey AS account_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    mentions = lines.select(F.col("l_orderkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.lit("MENTIONS").alias("rel"), none.alias("stance"))
    stances = lines.select(F.col("l_orderkey").alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.lit("STANCE").alias("rel"), F.col("l_returnflag").alias("stance"))
    own = posts(spark, sf_dir)
    places = own.select(F.col("post_id").alias("src"), F.col("district_id").alias("dst"), F.lit("IN_DISTRICT").alias("rel"), none.alias("stance"))
    authors = own.select(F.col("post_id").alias("src"), F.col("account_id").alias("dst"), F.lit("POSTED_BY").alias("rel"), none.alias("stance"))
    return mentions.union(stances).union(places).union(authors)


EDGES = (
    POSTS
    + """, edges AS (
  SELECT l_orderkey AS src, 'p' || l_partkey AS dst, 'MENTIONS' AS rel, NULL AS stance FROM lineitem
  UNION ALL SELECT l_orderkey, 's' || l_suppkey, 'STANCE', l_returnflag FROM lineitem
  UNION ALL SELECT post_id, district_id, 'IN_DISTRICT', NULL FROM posts
  UNION ALL SELECT post_id, account_id, 'POSTED_BY', NULL FROM posts)"""
)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation for each supplier, part and order: the surest of its line items."""
    lines = table(spark, sf_dir, "lineitem")
    lines = fusion.dealt(lines, lines.count(), "l_suppkey", "l_partkey")  # the count comes from the files' footers
    keyed = lines.groupBy("l_suppkey", "l_partkey", "l_orderkey").agg(F.round(F.max(1 - F.col("l_discount")) + 0.0, 6).alias("confidence"))
    return keyed.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("subject_id"), F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey")).alias("object_id"), F.col("l_orderkey").alias("chunk_id"), "confidence")


RELATIONS = """relations AS (
  SELECT 's' || l_suppkey AS subject_id, 'SUPPLIES' AS predicate, 'p' || l_partkey AS object_id, l_orderkey AS chunk_id,
         round(max(1 - l_discount) + 0.0, 6) AS confidence FROM lineitem GROUP BY l_suppkey, l_partkey, l_orderkey),
ways AS (SELECT subject_id AS u, object_id AS v, * FROM relations UNION ALL SELECT object_id, subject_id, * FROM relations),
degree AS (SELECT u AS id, count(*) AS degree FROM ways GROUP BY u)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit("Organization").alias("type"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("Concept").alias("type"))
    return suppliers.union(parts)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as templates give them, one row each: the relations with hops, chunk and source."""
    rel = relations(spark, sf_dir)
    seq = F.col("chunk_id")
    return rel.select("subject_id", "predicate", "object_id", (F.col("chunk_id") % 3 + 1).cast("int").alias("hops"), "confidence", F.array("chunk_id").alias("chunk_ids"), F.array(F.concat(F.lit("src"), F.col("chunk_id") % 7)).alias("sources"), F.concat(F.lit("order "), F.col("chunk_id")).alias("evidence"), F.lit("neighbourhood").alias("template"), seq.alias("seq"))


FACTS = (
    RELATIONS
    + """, facts AS (SELECT subject_id, predicate, object_id, CAST(chunk_id % 3 + 1 AS INTEGER) AS hops, confidence, chunk_id,
   'src' || (chunk_id % 7) AS source, 'order ' || chunk_id AS evidence FROM relations),
 merged AS (SELECT subject_id, predicate, object_id, min(hops) AS hops, max(confidence) AS confidence, list(chunk_id ORDER BY chunk_id) AS chunk_ids,
   count(DISTINCT source) AS n_sources, arg_min(evidence, chunk_id) AS evidence FROM facts GROUP BY ALL)"""
)


#: What ranking needs of a fact; ranks are numbered over written rows, so the rest isn't carried along.
RANKED_BY = ("subject_id", "predicate", "object_id", "hops", "confidence", "chunk_ids", "relevance")


def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduped facts with a relevance that depends on their key alone."""
    merged = fusion.dedupe_facts(facts(spark, sf_dir), n_rows=table(spark, sf_dir, "lineitem").count())
    number = lambda c: F.substring(c, 2, 12).cast("long")
    predicate = F.when(number("object_id") % 5 == 0, "LEADS").otherwise(F.col("predicate"))
    relevance = F.round((number("subject_id") * 31 + number("object_id") * 17) % 1000 / 1000.0, 4)
    return merged.withColumn("predicate", predicate).withColumn("relevance", relevance).select(*RANKED_BY)


RANKED = (
    FACTS
    + """, scored AS (SELECT subject_id, CASE WHEN CAST(substr(object_id, 2) AS BIGINT) % 5 = 0 THEN 'LEADS' ELSE predicate END AS predicate, object_id, confidence, chunk_ids,
   round((CAST(substr(subject_id, 2) AS BIGINT) * 31 + CAST(substr(object_id, 2) AS BIGINT) * 17) % 1000 / 1000.0::DOUBLE, 4) - 0.05::DOUBLE * (hops - 1) AS base FROM merged),
 anchors AS (SELECT * FROM scored WHERE predicate <> 'LEADS' ORDER BY base DESC, subject_id, predicate, object_id LIMIT 3),
 near AS (SELECT subject_id AS e FROM anchors UNION SELECT object_id FROM anchors),
 ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, len(chunk_ids) DESC, subject_id, predicate, object_id) AS rank FROM (
   SELECT *, round(base + CASE WHEN predicate = 'LEADS' THEN 0.2::DOUBLE + CASE WHEN subject_id IN (SELECT e FROM near) OR object_id IN (SELECT e FROM near) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END, 6) AS score FROM scored))"""
)


# ---------- posts ----------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_node_top(spark, sf_dir).limit(5)


def _where():
    return filters.conjunction([F.col("sentiment") == "F", F.col("category") == "BUILDING", *filters.posted_within(filters.TimeFilter(date(1996, 1, 1), date(1999, 12, 31)))])


_SQL_WHERE = "sentiment = 'F' AND category = 'BUILDING' AND posted_at >= TIMESTAMP '1996-01-01 00:00:00' AND posted_at <= TIMESTAMP '1999-12-31 23:59:59'"


@query(f"WITH {POSTS} SELECT count(*) AS n FROM posts WHERE {_SQL_WHERE}")
def post_filter_count(spark, sf_dir):
    return templates.total(posts(spark, sf_dir), edges(spark, sf_dir), _where())


@query(f"WITH {POSTS} SELECT district_id AS id, district AS name, count(DISTINCT post_id) AS n, min(post_id) AS sample_min, max(post_id) AS sample_max FROM posts WHERE sentiment = 'F' AND category = 'BUILDING' GROUP BY ALL ORDER BY n DESC, name LIMIT 10")
def facet_node_top(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("kind"))
    own = posts(spark, sf_dir)
    places = own.select(F.col("post_id").alias("src"), F.col("district_id").alias("dst"), F.lit("IN_DISTRICT").alias("rel"))
    return templates.facet_nodes(own, places, nations, "IN_DISTRICT", where=(F.col("sentiment") == "F") & (F.col("category") == "BUILDING"), top=10)


@query(f"WITH {POSTS} SELECT platform AS name, count(*) AS n, min(post_id) AS sample_min, max(post_id) AS sample_max FROM posts WHERE category = 'BUILDING' AND platform IS NOT NULL GROUP BY platform ORDER BY n DESC, name LIMIT 10")
def facet_property_top(spark, sf_dir):
    return templates.facet_property(posts(spark, sf_dir), edges(spark, sf_dir), "platform", F.col("category") == "BUILDING")


@query(f"""WITH {POSTS}, p AS (SELECT * FROM posts WHERE sentiment = 'F')
SELECT 'total' AS dim, 'matching posts' AS name, count(*) AS n FROM p
UNION ALL SELECT 'platform', platform, count(*) FROM p GROUP BY platform UNION ALL SELECT 'district', district, count(*) FROM p GROUP BY district""")
def facet_two_dims(spark, sf_dir):
    """The total and two facets, one of linked vertices and one of the posts' own columns, as the post engine counts them."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey")).alias("id"), F.lit("District").alias("label"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("kind"))
    engine = retrieve.PostEngine(posts(spark, sf_dir), edges(spark, sf_dir), nations, None, None)
    asked = retrieve.Analysis("en", "aggregation", group_by=["district", "platform"], top_n=25)
    found = engine.counts(asked, F.col("sentiment") == "F")
    return spark.createDataFrame([(r["dim"], r["name"], r["n"]) for r in found], "dim string, name string, n long")


@query(f"WITH {EDGES} SELECT district AS name, count(*) AS n, min(post_id) AS sample_min, max(post_id) AS sample_max FROM posts WHERE EXISTS (SELECT 1 FROM edges WHERE src = post_id AND dst IN ('p1', 'p2', 'p3')) GROUP BY district ORDER BY n DESC, name LIMIT 10")
def seeded_facet(spark, sf_dir):
    return templates.facet_property(posts(spark, sf_dir), edges(spark, sf_dir), "district", ids=["p1", "p2", "p3"])


@query(f"WITH {EDGES} SELECT DISTINCT post_id, posted_at, rel, dst FROM edges JOIN posts ON src = post_id WHERE dst IN ('p1', 's2') ORDER BY posted_at DESC NULLS FIRST, post_id, rel, dst LIMIT 100")
def entity_posts(spark, sf_dir):
    return templates.entity_posts(posts(spark, sf_dir), edges(spark, sf_dir), ["p1", "s2"])


@query(f"WITH {EDGES} SELECT DISTINCT src AS post_id, rel, dst FROM edges WHERE src IN (1, 2, 3, 4, 5, 6, 7, 8)")
def post_context(spark, sf_dir):
    return templates.post_context(edges(spark, sf_dir), list(range(1, 9)))


@query(f"""WITH {EDGES}, s AS (SELECT DISTINCT dst AS seed, src FROM edges WHERE dst IN ('p1', 'p2')), o AS (SELECT DISTINCT src, dst, rel FROM edges WHERE rel IN ('MENTIONS', 'STANCE', 'POSTED_BY') AND dst NOT IN ('p1', 'p2'))
SELECT seed, dst, rel, count(DISTINCT src) AS n, min(src) AS first_post, array_to_string(list_slice(list(DISTINCT src ORDER BY src), 1, 5), ',') AS samples FROM s JOIN o USING (src) GROUP BY ALL ORDER BY n DESC, dst, seed, rel LIMIT 100""")
def co_mentions(spark, sf_dir):
    return templates.co_mentions(posts(spark, sf_dir), edges(spark, sf_dir), ["p1", "p2"]).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(f"WITH {EDGES} SELECT dst AS id, stance, count(DISTINCT src) AS n, array_to_string(list_slice(list(DISTINCT src ORDER BY src), 1, 3), ',') AS samples FROM edges WHERE rel = 'STANCE' AND dst IN ('s1', 's2', 's3') GROUP BY dst, stance")
def stance_counts(spark, sf_dir):
    return templates.stance_counts(posts(spark, sf_dir), edges(spark, sf_dir), ["s1", "s2", "s3"]).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(f"WITH {POSTS} SELECT post_id, posted_at FROM posts WHERE {_SQL_WHERE} ORDER BY posted_at DESC NULLS FIRST, post_id LIMIT 8")
def filtered_posts(spark, sf_dir):
    return templates.filtered_posts(posts(spark, sf_dir), _where(), 8)


@query(f"""WITH {POSTS} SELECT count(*) FILTER (sentiment = 'F' AND category = 'BUILDING' AND district = 'NATION_3' AND platform = 'none') AS level_0,
 count(*) FILTER (sentiment = 'F' AND platform = 'none' AND district = 'NATION_3') AS level_1, count(*) FILTER (platform = 'none' AND district = 'NATION_3') AS level_2, count(*) FILTER (district = 'NATION_3') AS level_3, count(*) AS level_4 FROM posts""")
def drop_empty_filters(spark, sf_dir):
    tests = {"sentiment": F.col("sentiment") == "F", "category": F.col("category") == "BUILDING", "district": F.col("district") == "NATION_3", "platform": F.col("platform") == "none"}
    return filters.count_levels(posts(spark, sf_dir), tests, filters.levels(list(tests)))


# ---------- relations ----------


@query(f"WITH {RELATIONS} SELECT subject_id, predicate, object_id, chunk_id, confidence, 1 AS hops FROM relations WHERE subject_id IN ('s1', 's2') OR object_id IN ('s1', 's2') ORDER BY confidence DESC, subject_id, predicate, object_id, chunk_id LIMIT 100")
def neighbourhood(spark, sf_dir):
    return templates.neighbourhood(relations(spark, sf_dir), ["s1", "s2"])


_TWO_HOP = """hop AS (SELECT DISTINCT r.subject_id, r.predicate, r.object_id, r.chunk_id, r.confidence FROM ways f JOIN degree d ON d.id = f.v AND d.degree <= 35 JOIN ways r ON r.u = f.v
 WHERE f.u IN ('s1', 's2') AND f.v NOT IN ('s1', 's2') AND r.v <> f.u AND NOT (f.subject_id = r.subject_id AND f.predicate = r.predicate AND f.object_id = r.object_id AND f.chunk_id = r.chunk_id))"""


@query(f"WITH {RELATIONS}, {_TWO_HOP} SELECT *, 2 AS hops FROM hop ORDER BY confidence DESC, subject_id, predicate, object_id, chunk_id LIMIT 100")
def two_hop(spark, sf_dir):
    return templates.two_hop(relations(spark, sf_dir), ["s1", "s2"], hub=35)


@query(f"""WITH {RELATIONS}, step AS (SELECT DISTINCT u, v FROM ways WHERE u <> v), calm AS (SELECT id FROM degree WHERE degree <= 45), seeds AS (SELECT unnest(['s1', 's2', 's3', 'p1']) AS id),
paths AS (
 SELECT u AS a, v AS b, 1 AS hops, [u, v] AS nodes FROM step WHERE u IN (FROM seeds) AND v IN (FROM seeds) AND u < v
 UNION ALL SELECT e.u, f.v, 2, [e.u, e.v, f.v] FROM step e JOIN step f ON e.v = f.u WHERE e.u IN (FROM seeds) AND f.v IN (FROM seeds) AND e.u < f.v AND e.v <> f.v AND e.v IN (FROM calm)
 UNION ALL SELECT e.u, g.v, 3, [e.u, e.v, f.v, g.v] FROM step e JOIN step f ON e.v = f.u JOIN step g ON f.v = g.u
   WHERE e.u IN (FROM seeds) AND g.v IN (FROM seeds) AND e.u < g.v AND e.v <> g.v AND f.v <> e.u AND e.v IN (FROM calm) AND f.v IN (FROM calm))
SELECT a, b, hops, array_to_string(nodes, '>') AS path FROM (SELECT *, min(hops) OVER (PARTITION BY a, b) AS least FROM paths) WHERE hops = least ORDER BY a, b, nodes LIMIT 10""")
def shortest_paths(spark, sf_dir):
    found = templates.shortest_paths(relations(spark, sf_dir), ["s1", "s2", "s3", "p1"], hub=45)
    return found.select("a", "b", "hops", F.array_join("nodes", ">").alias("path"))


@query(f"WITH {RELATIONS} SELECT u AS id, count(*) AS n_relations FROM ways WHERE v IN ('s1', 's2', 's3') AND u NOT IN ('s1', 's2', 's3') GROUP BY u HAVING count(DISTINCT v) = 3")
def intersection(spark, sf_dir):
    return templates.linked_to_all(relations(spark, sf_dir), ["s1", "s2", "s3"])


@query(f"""WITH {RELATIONS}, near AS (SELECT subject_id, object_id, min(chunk_id) AS chunk_id FROM relations WHERE predicate = 'SUPPLIES' GROUP BY ALL)
SELECT subject_id AS entity_id, s_name AS name, count(*) AS n, array_to_string(list_slice(list(object_id || '#' || chunk_id ORDER BY object_id), 1, 5), ',') AS samples FROM near JOIN supplier ON subject_id = 's' || s_suppkey GROUP BY ALL ORDER BY n DESC, name LIMIT 10""")
def graph_aggregation(spark, sf_dir):
    return templates.aggregation(relations(spark, sf_dir), vertices(spark, sf_dir), predicate="SUPPLIES", kind="Organization").withColumn("samples", F.array_join(F.transform("samples", lambda f: F.concat(f["object_id"], F.lit("#"), f["chunk_id"])), ","))


@query(f"""WITH {EDGES} SELECT 'node' AS what, label, n FROM (SELECT 'Organization' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'Concept', count(*) FROM part UNION ALL SELECT 'Event', 0)
UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel""")
def label_counts(spark, sf_dir):
    return graph.store_counts(vertices(spark, sf_dir).withColumnRenamed("type", "label"), edges(spark, sf_dir), ["Organization", "Concept", "Event"])


@query("SELECT 'p' || p_partkey AS id, p_name AS name, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def known_entities(spark, sf_dir):
    mentions = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    parts = vertices(spark, sf_dir).filter(F.col("type") == "Concept")
    return graph.known_entities(parts, mentions, limit=None).select("id", "name", "n")


@query("SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphans(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return graph.orphans(docs.select(F.col("doc_id").alias("id")), labels.select(F.col("doc_id").alias("id")))


@query("""WITH old AS (SELECT doc_id AS chunk_id, source, md5(text) AS text FROM documents), fresh AS (SELECT doc_id + 5 AS chunk_id, source, md5(text || '!') AS text FROM documents WHERE source = 'src3'),
kept AS (SELECT * FROM old o WHERE source <> 'src3' AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.chunk_id = o.chunk_id) UNION ALL SELECT * FROM fresh)
SELECT source, count(*) AS n, min(chunk_id) AS first_id, (SELECT count(*) FROM old o WHERE source = 'src3' AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.chunk_id = o.chunk_id)) AS removed FROM kept GROUP BY source""")
def replace_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("chunk_id"), "source", F.md5("text").alias("text"))
    new = docs.filter(F.col("source") == "src3").select((F.col("doc_id") + 5).alias("chunk_id"), "source", F.md5(F.concat("text", F.lit("!"))).alias("text"))
    after, removed = graph.replace_source(old, new, "src3")
    return after.groupBy("source").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id")).join(removed.agg(F.count("*").alias("removed")))


@query("SELECT o_orderkey AS src, next AS dst FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders) WHERE next IS NOT NULL")
def next_edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("doc_id"), F.struct("o_orderdate", "o_orderkey").alias("chunk_index"))
    return graph.next_edges(orders)


# ---------- vectors, facts, ranking ----------


def _unit(n: int):
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {n})"


def _vector(spark, sf_dir, n: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == n).first()["embedding"]


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_unit(0)}::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {_unit(0)}::DOUBLE[]) DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    found = vectors.search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 20, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH a AS (SELECT vec_id AS anchor, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 16),
cells AS (SELECT vec_id, arg_min(anchor, (-s, anchor)) AS cell FROM (SELECT e.vec_id, anchor, list_dot_product(e.embedding::DOUBLE[], c) AS s FROM embeddings e, a) GROUP BY vec_id),
near AS (SELECT anchor FROM a ORDER BY list_dot_product(c, {_unit(0)}::DOUBLE[]) DESC, anchor LIMIT 10)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_unit(0)}::DOUBLE[]), 6) AS score FROM embeddings JOIN cells USING (vec_id) WHERE cell IN (SELECT anchor FROM near)
ORDER BY list_dot_product(embedding::DOUBLE[], {_unit(0)}::DOUBLE[]) DESC, vec_id LIMIT 20""")
def ann_topk(spark, sf_dir):
    """The best 20 of the 10 nearest of 16 cells. The cells lie around the first 16 vectors, so that SQL can say them; tests
    measure the recall of fitted ones."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("embedding").isNotNull())
    anchors = [r["embedding"] for r in rows.filter(F.col("vec_id") < 16).orderBy("vec_id").collect()]
    index = ann.CellIndex(Store(spark, scratch_dir(spark, "cells")), "v", 16, id_col="vec_id")
    index.build(rows, np.array(anchors, dtype=np.float64))
    return index.search(_vector(spark, sf_dir, 0), 20, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {_unit(1)}::DOUBLE[]), 6) AS score FROM embeddings WHERE label = 3 ORDER BY list_dot_product(embedding::DOUBLE[], {_unit(1)}::DOUBLE[]) DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf_dir):
    found = vectors.search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 1), 20, F.col("label") == 3, id_col="vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH x AS (SELECT label, i AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM x GROUP BY label),
c AS (SELECT label AS source, list(m / size ORDER BY pos) AS v FROM x JOIN n USING (label) GROUP BY label), s AS (SELECT source, label, vec_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings JOIN c ON source <> label)
SELECT source, label, vec_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn = 1""")
def grouped_top1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.best_in_groups(rows, vectors.centroids(rows, "label"), "label", "vec_id", limit=None, threshold=None)


@query(f"""WITH v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], {_unit(0)}::DOUBLE[]) DESC, vec_id) AS vector_rank FROM embeddings QUALIFY vector_rank <= 50),
g AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS graph_rank FROM documents QUALIFY graph_rank <= 50), m AS (SELECT doc_id AS chunk_id, CAST(quality + toxic AS BIGINT) AS n FROM labels),
f AS (SELECT chunk_id, vector_rank, graph_rank, coalesce(n, 0) AS entity_mentions, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + graph_rank), 0) + 0.01::DOUBLE * coalesce(n, 0), 6) AS fused_score FROM v FULL JOIN g USING (chunk_id) LEFT JOIN m USING (chunk_id))
SELECT chunk_id, coalesce(vector_rank, 0) AS vector_rank, coalesce(graph_rank, 0) AS graph_rank, entity_mentions, fused_score, row_number() OVER (ORDER BY fused_score DESC, vector_rank NULLS LAST, graph_rank NULLS LAST, chunk_id) AS fused_rank FROM f""")
def rrf_fusion(spark, sf_dir):
    from pyspark.sql import Window

    hits = vectors.search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 0), 50, id_col="vec_id")
    vector = hits.select(F.col("vec_id").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long").alias("rank"))
    longest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars").orderBy(F.desc("n_chars"), "chunk_id").limit(50)
    graph_ = longest.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "chunk_id")).cast("long").alias("rank"))
    mentions = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") + F.col("toxic")).cast("long").alias("n"))
    fused = fusion.reciprocal_rank_fusion(vector, graph_, mentions)
    return fused.select("chunk_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("vector_rank", "graph_rank")], "entity_mentions", "fused_score", F.col("fused_rank").cast("long").alias("fused_rank"))


@query(f"WITH {FACTS} SELECT subject_id, predicate, object_id, hops, confidence, array_to_string(chunk_ids, ',') AS chunk_ids, n_sources, evidence FROM merged")
def dedupe_facts(spark, sf_dir):
    merged = fusion.dedupe_facts(facts(spark, sf_dir), n_rows=table(spark, sf_dir, "lineitem").count())
    return merged.select("subject_id", "predicate", "object_id", "hops", "confidence", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"), F.size("sources").cast("long").alias("n_sources"), "evidence")


@query(f"WITH {RANKED} SELECT subject_id, predicate, object_id, score, CAST(rank AS BIGINT) AS rank FROM ranked")
def rank_facts(spark, sf_dir):
    ranked = fusion.rank_facts(merged_facts(spark, sf_dir), "LEADS")
    return ranked.select("subject_id", "predicate", "object_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {RANKED}, e AS (SELECT DISTINCT rank, unnest(chunk_ids) AS chunk_id FROM ranked), g AS (SELECT chunk_id, min(rank) AS best, count(*) AS support FROM e GROUP BY chunk_id) SELECT chunk_id, best, support, row_number() OVER (ORDER BY best, support DESC, chunk_id) AS pos FROM g")
def graph_chunk_order(spark, sf_dir):
    ranked = fusion.rank_facts(merged_facts(spark, sf_dir), "LEADS")
    return fusion.chunk_order(ranked).select("chunk_id", F.col("best").cast("long").alias("best"), "support", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {RANKED}, c AS (SELECT rank, sum(length(subject_id || predicate || object_id) + 4) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM ranked) SELECT CAST(rank AS BIGINT) AS rank, CAST(used AS BIGINT) AS used FROM c WHERE used <= 3000 // 4")
def budget_prefix(spark, sf_dir):
    ranked = fusion.rank_facts(merged_facts(spark, sf_dir), "LEADS", top=fusion.most_facts(3000))
    return fusion.facts_within(ranked, F.length(F.concat("subject_id", "predicate", "object_id")), 3000).select(F.col("rank").cast("long").alias("rank"), F.col("used").cast("long").alias("used"))


@query("""WITH RECURSIVE items AS (
  SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT), l_partkey % 30) AS i, CAST(l_quantity AS BIGINT) AS c, l_partkey % 30 AS f, l_orderkey % 160 + 40 AS budget FROM lineitem),
facts(q, i, budget, used, full_, kept) AS (
  SELECT DISTINCT q, CAST(0 AS BIGINT), budget, CAST(0 AS BIGINT), false, '' FROM items
  UNION ALL SELECT s.q, x.i, s.budget, CASE WHEN NOT full_ AND used + f + 4 <= s.budget // 4 THEN used + f + 4 ELSE used END, full_ OR used + f + 4 > s.budget // 4,
    CASE WHEN NOT full_ AND used + f + 4 <= s.budget // 4 THEN kept || (x.i - 1) || ',' ELSE kept END FROM facts s JOIN items x ON x.q = s.q AND x.i = s.i + 1),
begun AS (SELECT q, budget, arg_max(used, i) AS used, arg_max(kept, i) AS facts FROM facts GROUP BY q, budget),
chunks(q, i, budget, used, facts, kept) AS (
  SELECT q, CAST(0 AS BIGINT), budget, used, facts, '' FROM begun
  UNION ALL SELECT s.q, x.i, s.budget, CASE WHEN used + c + 12 <= s.budget THEN used + c + 12 ELSE used END, facts, CASE WHEN used + c + 12 <= s.budget THEN kept || (x.i - 1) || ',' ELSE kept END
    FROM chunks s JOIN items x ON x.q = s.q AND x.i = s.i + 1)
SELECT q AS question, rtrim(arg_max(facts, i), ',') AS facts, rtrim(arg_max(kept, i), ',') AS chunks, arg_max(used, i) AS used FROM chunks GROUP BY q""")
def budget_fold(spark, sf_dir):
    """An order is a question, its lines are its ranked chunks and facts: what fits, for all questions in one plan."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("c"), (F.col("l_partkey") % 30).alias("f")).alias("x"))
    asked = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    fit = fusion.within_budget(F.col("x.c"), F.col("x.f"), F.col("l_orderkey") % 160 + 40).alias("fit")
    listed = lambda c: F.array_join(F.col(f"fit.{c}").cast("array<string>"), ",").alias(c)
    return asked.select(F.col("l_orderkey").alias("question"), fit).select("question", listed("facts"), listed("chunks"), "fit.used")


@query("WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 20 - 6 AS rerank, CAST(NULL AS DOUBLE) AS relevance FROM embeddings) SELECT round(max(1 / (1 + exp(-rerank))), 6) AS best, max(1 / (1 + exp(-rerank))) >= 0.05 AS evidence FROM s")
def evidence_gate(spark, sf_dir):
    scores = table(spark, sf_dir, "embeddings").select((F.element_at("embedding", 1).cast("double") * 20 - 6).alias("rerank"), F.lit(None).cast("double").alias("relevance"))
    return fusion.has_evidence(scores)


BM25 = """WITH w AS (SELECT p_partkey AS id, list_filter(regexp_split_to_array(lower(p_name), '[\\p{P}\\p{S}\\p{Z}\\s]+'), lambda x: x <> '') AS t FROM part), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
q AS (SELECT DISTINCT unnest(list_sort(list_distinct(list_filter(regexp_split_to_array(lower((SELECT min(p_name) || ' ' || max(p_name) FROM part)), '[\\p{P}\\p{S}\\p{Z}\\s]+'), lambda x: x <> '')))[1:3]) AS term),
tf AS (SELECT id, term, len(t) AS length, len(list_filter(t, lambda x: x = term)) AS tf FROM w, q), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score, count(*) FILTER (tf > 0) AS terms FROM tf JOIN df USING (term), n
GROUP BY id HAVING count(*) FILTER (tf > 0) > 0 ORDER BY score DESC, id LIMIT 50"""


@query(BM25)
def bm25_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = parts.agg(F.min("p_name").alias("a"), F.max("p_name").alias("b")).first()
    query_ = sorted(set(text.plain_words(f"{names['a']} {names['b']}")))[:3]
    return fulltext.bm25(parts, query_, "p_partkey", "p_name", 50)


# ---------- text ----------


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|user ' || (user_id % 7) WHEN 1 THEN '' ELSE 'Plain name' END AS names FROM events")
def json_props(spark, sf_dir):
    """Name lists kept as JSON text: repeated spellings, empty texts, and text that is no list."""
    listed = F.concat(F.lit('["'), "event_type", F.lit(' ", "'), F.upper("event_type"), F.lit('", "user  '), F.col("user_id") % 7, F.lit('", "--"]'))
    made = F.when(F.col("event_id") % 3 == 0, listed).when(F.col("event_id") % 3 == 1, "").otherwise("Plain  name.")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.json_names(made), "|").alias("names"))


@query("SELECT doc_id, md5(replace(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' ', '_')) AS key_md5, len(list_filter(regexp_split_to_array(lower(text), '[\\p{P}\\p{S}\\p{Z}\\s]+'), lambda x: x <> '')) AS n_words, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(chr(9) || replace(text, ' ', '  ') || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || ' ' || chr(64257) || 'n '), chr(64257), 'fi'), '\r\n?', chr(10), 'g'), '[ \t\\x{00a0}]+', ' ', 'g'), '(?m)^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g').trim(' ' || chr(10) || chr(9))) AS tidy_md5 FROM documents")
def text_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    messy = F.concat(F.lit("\t"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\r\n \n\n ﬁn "))
    return docs.select("doc_id", F.md5(text.name_key(F.col("text"))).alias("key_md5"), F.size(text.words(F.col("text"))).cast("long").alias("n_words"), F.md5(text.normalize_text(messy)).alias("tidy_md5"))


@query("SELECT o_orderkey, 'call [phone removed] or id 21' || lpad(CAST(o_custkey AS VARCHAR), 17, '0') || ' now' AS masked FROM orders")
def phone_mask(spark, sf_dir):
    made = F.concat(F.lit("call +91 9"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" or id 21"), F.lpad(F.col("o_custkey").cast("string"), 17, "0"), F.lit(" now"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.mask_phones(made).alias("masked"))


@query("SELECT doc_id, 'chunk:' || substr(sha256(doc_id || '|0|' || text), 1, 24) AS chunk_id, 'doc:' || substr(sha256(text), 1, 16) AS hashed_id FROM documents")
def doc_ids_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.chunk_id(F.col("doc_id").cast("string"), F.lit(0), F.col("text")).alias("chunk_id"), text.doc_id(F.col("text")).alias("hashed_id"))


@query("""WITH t AS (SELECT CASE doc_id % 5 WHEN 0 THEN text || repeat('क', n_chars // 2) WHEN 1 THEN '1234 ...' ELSE text END AS t FROM documents),
c AS (SELECT len(regexp_extract_all(t, '[\\x{0900}-\\x{097F}]')) AS dev, len(regexp_extract_all(t, '[A-Za-z]')) AS latin FROM t)
SELECT CASE WHEN dev = 0 AND latin = 0 THEN 'unknown' WHEN dev > latin THEN 'hi' ELSE 'en' END AS language, count(*) AS n FROM c GROUP BY 1""")
def lang_counts(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.expr("repeat('क', CAST(n_chars DIV 2 AS INT))"))).when(F.col("doc_id") % 5 == 1, "1234 ...").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(text.script_language(mixed).alias("language")).agg(F.count("*").alias("n"))


def _votes() -> str:
    quoted = lambda ws: ", ".join(f"'{w}'" for w in ws)
    return ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({quoted(ws)}))), 'o': {-i}, 'l': '{kind}'}}" for i, (kind, ws) in enumerate(text.STOP_WORDS.items()))


@query(f"""WITH t AS (SELECT doc_id, lang, text AS t, list_filter(regexp_split_to_array(lower(text), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\s]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT lang, CASE WHEN regexp_matches(t, '[A-Za-z]') THEN list_max([{_votes()}]).l ELSE 'unknown' END AS language FROM t)
SELECT lang, language, count(*) AS n FROM v GROUP BY ALL""")
def lang_votes(spark, sf_dir):
    """Documents by the language they are labelled with and the one that their words show."""
    return table(spark, sf_dir, "documents").groupBy("lang", text.detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, 'Order total is ' || o_orderkey || ' units in all [C' || (o_orderkey % 4 + 1) || ', G' || (o_orderkey % 3 + 1) || ']. It was placed by a customer that nobody cited here.' AS answer FROM orders),
c AS (SELECT o_orderkey, regexp_extract_all(answer, '[CG]\\d+') AS ids FROM a)
SELECT o_orderkey, array_to_string(list_filter(ids, lambda x: x IN ('C1', 'C2', 'G1')), ',') AS used, array_to_string(list_filter(ids, lambda x: x NOT IN ('C1', 'C2', 'G1')), ',') AS invalid,
 CASE WHEN len(list_filter(ids, lambda x: x IN ('C1', 'C2', 'G1'))) = 0 THEN 2 ELSE 1 END AS n_uncited FROM c""")
def citation_validate(spark, sf_dir):
    key = F.col("o_orderkey")
    answer = F.concat(F.lit("Order total is "), key, F.lit(" units in all [C"), key % 4 + 1, F.lit(", G"), key % 3 + 1, F.lit("]. It was placed by a customer that nobody cited here."))
    known = F.array(F.lit("C1"), F.lit("C2"), F.lit("G1"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer"))
    told = rows.select("o_orderkey", citations.checked(F.col("answer"), known).alias("c"))
    return told.select("o_orderkey", F.array_join("c.used", ",").alias("used"), F.array_join("c.invalid", ",").alias("invalid"), F.size("c.uncited").cast("long").alias("n_uncited"))


@query("""SELECT o_orderkey, 4 AS n, CAST(least(o_orderdate::DATE, date_trunc('month', o_orderdate)::DATE) AS VARCHAR) AS first_day, CAST(last_day(o_orderdate) AS VARCHAR) AS last_day,
 strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%d/%m/%Y') || '|' || strftime(o_orderdate, '%-d %B %Y') || '|' || strftime(o_orderdate, '%B %Y') AS mentions FROM orders""")
def date_spans(spark, sf_dir):
    at = F.col("o_orderdate")
    made = F.concat(F.lit("Due "), F.date_format(at, "yyyy-MM-dd"), F.lit(" paid "), F.date_format(at, "dd/MM/yyyy"), F.lit(" sent "), F.date_format(at, "d MMMM yyyy"), F.lit(" closed in "), F.date_format(at, "MMMM yyyy"), F.lit(" for ₹1,240 crore"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.date_spans(made).alias("spans"))
    whole = dates.overall(F.col("spans"))
    return rows.select("o_orderkey", F.size("spans").alias("n"), whole["start"].cast("string").alias("first_day"), whole["end"].cast("string").alias("last_day"), F.array_join(F.transform("spans", lambda s: s["text"]), "|").alias("mentions"))


# ---------- more operators of the inventory ----------


@query(f"WITH {EDGES} SELECT src AS post_id, count(DISTINCT dst) AS n FROM edges WHERE dst IN ('p1', 'p2', 's1', 's2', 'd3') AND src BETWEEN 1 AND 400 GROUP BY src")
def entity_mention_counts(spark, sf_dir):
    found = templates.entity_mentions(edges(spark, sf_dir), list(range(1, 401)), ["p1", "p2", "s1", "s2", "d3"])
    return found.withColumnRenamed("src", "post_id")


@query("""WITH x AS (SELECT label, i AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM x GROUP BY label)
SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(m / size, 6) AS x FROM x JOIN n USING (label)""")
def centroids(spark, sf_dir):
    found = vectors.centroids(table(spark, sf_dir, "embeddings"), "label")
    return found.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {RELATIONS}, chunk_rank AS (SELECT o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS r FROM orders QUALIFY r < 10)
SELECT entity_id, round(sum(1.0::DOUBLE / (1 + r)), 6) AS score FROM (SELECT DISTINCT subject_id AS entity_id, r FROM relations JOIN chunk_rank USING (chunk_id) UNION SELECT object_id, r FROM relations JOIN chunk_rank USING (chunk_id)) JOIN degree ON id = entity_id AND degree <= 50
GROUP BY entity_id ORDER BY score DESC, entity_id LIMIT 5""")
def seed_entities(spark, sf_dir):
    from pyspark.sql import Window

    rel = relations(spark, sf_dir)
    mentions = rel.select("chunk_id", F.col("subject_id").alias("entity_id")).union(rel.select("chunk_id", F.col("object_id").alias("entity_id"))).distinct()
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    ranked = top.select(F.col("o_orderkey").alias("chunk_id"), (F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1).alias("chunk_rank"))
    return fusion.seed_entities(graph.entities_in_chunks(mentions, rel, ranked, 50), 5)


@query("SELECT l_suppkey AS src, l_partkey AS dst, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS labels, count(*) AS n FROM lineitem GROUP BY ALL")
def merged_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return evalkit.merged_edges(lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("label")))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'it''s (' || o_orderpriority || '); "' || o_orderstatus || '"' || chr(10) || 'end' AS text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS author FROM orders""")
def dump_round_trip(spark, sf_dir):
    """Orders written to a dump as INSERT statements, with line ends inside values, and read back by the dump reader."""
    orders = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("it''s ("), "o_orderpriority", F.lit('); "'), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, '"\\nend').otherwise('"\nend'))
    author = F.when(F.col("o_orderkey") % 3 == 0, "NULL").otherwise(F.concat(F.lit("'"), F.col("o_custkey"), F.lit("'")))
    statements = orders.select(F.concat(F.lit("INSERT INTO `t` (`id`, `text`, `author`) VALUES ("), F.col("o_orderkey"), F.lit(", '"), said, F.lit("', "), author, F.lit(");")).alias("sql"))
    path = scratch_dir(spark, "dump")
    statements.write.text(path)
    return mysqldump.one_table(mysqldump.read_dump(spark, path, ["t"]), "t", ["id", "text", "author"])


@query(None)
def chunk_documents(spark, sf_dir):
    """The documents as chunks of at most 128 tokens. Recursive splitting can't be said in SQL: tests hold it to its rules."""
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), "source", "text")
    return chunking.chunk_pages(pages, 128, 20).select("chunk_id", "doc_id", "chunk_index", "token_count", "language", "date_start", "date_end")


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[\\p{P}\\p{S}\\p{Z}\\s]+'), lambda x: x <> '') AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM w),
tf AS (SELECT id, term, len(t) AS length, len(list_filter(t, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['thanes', 'uber', 'reou', 'cion']) AS term)), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
SELECT CAST(id AS VARCHAR) AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score, count(*) FILTER (tf > 0) AS terms
FROM tf JOIN df USING (term), n GROUP BY id HAVING count(*) FILTER (tf > 0) > 0""")
def stored_index_search(spark, sf_dir):
    """All documents of four terms, from an index that is built first and then updated by the sources of a few names."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    index = fulltext.StoredIndex(Store(spark, scratch_dir(spark, "index")), "documents", 32)
    index.replace(docs.withColumn("text", F.when(F.col("source") == "src3", F.concat("text", F.lit(" uber uber cion"))).otherwise(F.col("text"))))
    index.replace(docs.filter("source = 'src3'"))
    return index.search(["thanes", "über", "réou", "ción"], limit=None)


@query(f"WITH b AS ({BM25}) SELECT id, score, terms FROM b WHERE score >= 0.5::DOUBLE * (SELECT max(score) FROM b)")
def near_best_hits(spark, sf_dir):
    """Full-text hits with at least half of the best score."""
    return fulltext.near_best(bm25_search(spark, sf_dir))


@query(f"""WITH {RELATIONS}, t AS (SELECT * FROM ways WHERE v IN ('s1', 's2', 's3') AND u NOT IN ('s1', 's2', 's3')), f AS (SELECT u FROM t GROUP BY u HAVING count(DISTINCT v) = 3)
SELECT DISTINCT subject_id, predicate, object_id, chunk_id, confidence, 1 AS hops FROM t WHERE u IN (FROM f) ORDER BY confidence DESC, subject_id, predicate, object_id, chunk_id LIMIT 100""")
def intersection_facts(spark, sf_dir):
    """The relations between three seeds and whatever all of them are linked to."""
    return templates.intersection(relations(spark, sf_dir), ["s1", "s2", "s3"])


@query(f"WITH {FACTS} SELECT subject_id, predicate, object_id, row_number() OVER (ORDER BY hops, confidence DESC, len(chunk_ids) DESC, subject_id, predicate, object_id) AS rank FROM merged")
def rank_facts_unscored(spark, sf_dir):
    return fusion.rank_facts_unscored(merged_facts(spark, sf_dir).withColumn("predicate", F.lit("SUPPLIES"))).select("subject_id", "predicate", "object_id", "rank")


@query("""WITH x AS (SELECT label, i AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS size FROM x GROUP BY label),
c AS (SELECT label AS source, list(m / size ORDER BY pos) AS v FROM x JOIN n USING (label) GROUP BY label), s AS (SELECT source, label, round(max(list_dot_product(embedding::DOUBLE[], v)), 4) AS score FROM embeddings JOIN c ON source <> label GROUP BY ALL),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, label) <= 3)
SELECT least(source, label) AS a, greatest(source, label) AS b, max(score) AS score FROM k WHERE score >= 0.2 GROUP BY ALL""")
def similar_documents(spark, sf_dir):
    """The three nearest other groups of each, those above a threshold, as one edge a pair."""
    rows = table(spark, sf_dir, "embeddings")
    near = vectors.best_in_groups(rows, vectors.centroids(rows, "label"), "label", "vec_id", limit=3, threshold=0.2)
    return graph.similar_edges(near.select(F.col("source").alias("a"), F.col("label").alias("b"), "score"))


@query("""WITH o AS (SELECT p_partkey AS id, p_name AS name, 'Concept' AS type, ['Concept'] AS labels, [p_brand, 'x'] AS aliases FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS id, upper(p_name) AS name, 'Event' AS type, [p_type, p_brand] AS aliases FROM part WHERE p_partkey % 3 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(n.type, o.type) AS type, array_to_string(list_concat(coalesce(o.labels, []), CASE WHEN n.type IS NULL THEN [] ELSE [n.type] END), ',') AS labels,
 array_to_string(list_concat(list_filter(coalesce(o.aliases, []), lambda a: NOT list_contains(coalesce(n.aliases, []), a)), coalesce(n.aliases, [])), ',') AS aliases FROM o FULL JOIN n ON o.id = n.id""")
def merge_entities(spark, sf_dir):
    """Entities after a merge: the first name stays, the newest type holds, labels and aliases pile up."""
    part = table(spark, sf_dir, "part")
    old = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("Concept").alias("type"), F.array(F.lit("Concept")).alias("labels"), F.array("p_brand", F.lit("x")).alias("aliases"))
    new = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), F.lit("Event").alias("type"), F.array("p_type", "p_brand").alias("aliases"))
    return graph.merge_entities(old, new).withColumns({c: F.array_join(c, ",") for c in ("labels", "aliases")})


@query(f"""WITH {RELATIONS} SELECT subject_id, object_id, predicate, chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 0.25::DOUBLE ELSE confidence END AS confidence FROM relations WHERE chunk_id % 2 = 0 OR chunk_id % 3 = 0""")
def merge_relations(spark, sf_dir):
    """Relations written again: of two new ones with the same ends, predicate and chunk the later counts."""
    rel = relations(spark, sf_dir)
    again = rel.filter("chunk_id % 3 = 0").withColumn("w", F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit(0.25).alias("confidence")), F.struct(F.lit(1).alias("seq"), F.lit(0.75).alias("confidence")))))
    new = again.select("subject_id", "object_id", "predicate", "chunk_id", "w.confidence", "w.seq")
    return graph.merge_relations(rel.filter("chunk_id % 2 = 0"), new)


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, NULL AS seg FROM customer), n AS (SELECT c_custkey + 3 AS id, NULL AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 4 = 0)
SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""")
def upsert_rows(spark, sf_dir):
    """New rows instead of old ones with the same key; a column that one side lacks is null there."""
    customer = table(spark, sf_dir, "customer")
    new = customer.filter("c_custkey % 4 = 0").select((F.col("c_custkey") + 3).alias("id"), F.col("c_mktsegment").alias("seg"))
    return graph.upsert(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), new, ["id"])


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.point_id(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'WORKS_FOR' WHEN 1 THEN 'LOCATED_IN' WHEN 2 THEN 'SUPPLIES' ELSE 'RELATED_TO' END AS predicate, CASE p_partkey % 4 WHEN 0 THEN 'Ann works for ' || p_name WHEN 1 THEN p_name || ' located in Ann' WHEN 2 THEN p_name || ' supplies Ann' ELSE p_name || ' related to Ann' END AS sentence FROM part""")
def fact_forms(spark, sf_dir):
    """Predicates as models spell them, facts put the right way round by their types, and as a sentence."""
    raw = F.element_at(F.array(F.lit("works for"), F.lit("Located-In"), F.lit(" supplies!"), F.lit("dances with")), (F.col("p_partkey") % 4 + 1).cast("int"))
    predicate = text.normalize_predicate(raw)
    ends = text.orient(predicate, F.struct(F.col("p_name").alias("name"), F.lit("Organization").alias("type")), F.struct(F.lit("Ann").alias("name"), F.lit("Person").alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", predicate.alias("predicate"), text.fact_sentence(ends["s"]["name"], predicate, ends["o"]["name"]).alias("sentence"))


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(CASE WHEN length(t) <= 350 THEN t ELSE regexp_replace(substr(t, 1, 350), ' [^ ]*$', '') || ' …' END) AS excerpt_md5, CASE WHEN doc_id % 2 = 0 THEN 'src ' || source END AS name FROM t JOIN documents USING (doc_id)""")
def excerpts(spark, sf_dir):
    """Texts cut at a word, and names freed of stray punctuation; names that are too long or hold no letter are null."""
    spaced = F.regexp_replace("text", "\\s+", " ")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" - src  "), "source", F.lit(" ;"))).otherwise(F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("x"), F.lit(81))).otherwise(" -- "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cut_at_word(spaced, 350)).alias("excerpt_md5"), text.clean_name(name).alias("name"))


@query("""SELECT n_nationkey, unnest([n_name, n_name || ' > Inner', n_name || ' > Inner > Deep', 'Last']) AS section, unnest(['# ' || n_name, '## Inner', '### Deep', '# Last']) AS first_line, unnest([2, 2, 6, 2]) AS n_lines FROM nation""")
def markdown_sections(spark, sf_dir):
    """Sections of Markdown texts; what stands in a fence is no heading, and headings without text go."""
    made = F.concat(F.lit("# "), "n_name", F.lit("\nlead\n## Inner\nbody\n### Deep\nmore\n```\n# not one\n```\nrest\n# Last\nend"))
    parts = files.markdown_sections(table(spark, sf_dir, "nation").select("n_nationkey", made.alias("text")))
    return parts.select("n_nationkey", "section", F.substring_index("text", "\n", 1).alias("first_line"), F.size(F.split("text", "\n")).alias("n_lines"))


@query(f"""WITH {EDGES}, v AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier), c AS (SELECT dst, count(DISTINCT src) AS posts FROM edges GROUP BY dst)
SELECT id, name, coalesce(posts, 0) AS posts FROM v LEFT JOIN c ON id = dst""")
def nameable_nodes(spark, sf_dir):
    """Vertices that a question can name, with the posts that link to them."""
    nodes = vertices(spark, sf_dir).withColumnRenamed("type", "label")
    return graph.name_index(nodes, edges(spark, sf_dir), ["Organization"]).select("id", "name", "posts")


@query("""SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-07-01' GROUP BY 1""")
def overlapping_spans(spark, sf_dir):
    """Rows whose span of thirty days touches some months."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), stamp("o_orderdate").alias("date_start"), stamp(F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("date_end"))
    kept = spans.filter(filters.conjunction(filters.overlaps(filters.TimeFilter(date(1997, 3, 1), date(1997, 6, 30)))))
    return kept.groupBy("priority").agg(F.count("*").alias("n"))
