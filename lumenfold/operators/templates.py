"""Graph patterns as joins over edge tables.

``relations`` is a multigraph of evidence: subject_id, predicate, object_id, chunk_id, confidence (more columns may
follow). ``edges`` links posts to what they name: src, dst, rel. Seeds are a handful of ids, so they are literals that
reach the scans; every limit has a total order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_KEY = ("subject_id", "predicate", "object_id", "chunk_id")
CO_RELATIONS = ("MENTIONS", "MENTIONS_ACCOUNT", "POSTED_BY", "TAGGED", "STANCE", "PART_OF")


def undirected(relations: DataFrame) -> DataFrame:
    """Each relation seen from both of its ends: u, v and the relation's own columns."""
    there = relations.select(F.col("subject_id").alias("u"), F.col("object_id").alias("v"), "*")
    back = relations.filter("subject_id <> object_id").select(F.col("object_id").alias("u"), F.col("subject_id").alias("v"), "*")
    return there.unionByName(back)


def degrees(relations: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Edges at each vertex, of any kind and direction. ``among`` (a table with id) names the vertices that matter: the
    ends of others go before anything is counted."""
    ends = relations.select(F.col("subject_id").alias("id")).unionAll(relations.select(F.col("object_id").alias("id")))
    if among is not None:
        ends = ends.join(among.select("id").distinct(), "id", "left_semi")
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def scoped(relations: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Only relations whose evidence chunk is allowed (a table with chunk_id), or all."""
    return relations if allowed is None else relations.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")


def _best(facts: DataFrame, limit: int) -> DataFrame:
    return facts.orderBy(F.desc("confidence"), *FACT_KEY).limit(limit)


def neighbourhood(relations: DataFrame, ids: Sequence, limit: int = 100, allowed: DataFrame | None = None) -> DataFrame:
    """Relations at any seed, the surest first."""
    at_seed = F.col("subject_id").isin(*ids) | F.col("object_id").isin(*ids)
    return _best(scoped(relations.filter(at_seed), allowed).select(*FACT_KEY, "confidence").distinct().withColumn("hops", F.lit(1)), limit)


def two_hop_pairs(relations: DataFrame, ids: Sequence, hub: int, allowed: DataFrame | None = None) -> DataFrame:
    """Second relations of seed - m - n: m is no seed and no hub, n is not the seed itself, no relation is used twice."""
    both = undirected(relations)
    first = both.filter(F.col("u").isin(*ids) & ~F.col("v").isin(*ids)).select(F.col("u").alias("seed"), F.col("v").alias("m"), *[F.col(c).alias(f"f_{c}") for c in FACT_KEY])
    calm = degrees(relations, first.select(F.col("m").alias("id"))).filter(F.col("degree") <= hub).select(F.col("id").alias("m"))
    first = first.join(calm, "m", "left_semi")
    second = undirected(scoped(relations, allowed)).withColumnRenamed("u", "m").withColumnRenamed("v", "n")
    same = reduce(lambda a, b: a & b, [F.col(f"f_{c}").eqNullSafe(F.col(c)) for c in FACT_KEY])
    return first.join(second, "m").filter((F.col("n") != F.col("seed")) & ~same)


def two_hop(relations: DataFrame, ids: Sequence, hub: int = 50, limit: int = 100, allowed: DataFrame | None = None) -> DataFrame:
    found = two_hop_pairs(relations, ids, hub, allowed).select(*FACT_KEY, "confidence").distinct()
    return _best(found.withColumn("hops", F.lit(2)), limit)


def shortest_paths(relations: DataFrame, ids: Sequence, hub: int = 50, most_paths: int = 10) -> DataFrame:
    """All shortest paths of at most three steps between each two seeds: a, b, hops, nodes. Steps ignore direction, no
    inner vertex is a hub, and parallel relations count as one step."""
    step = undirected(relations).select("u", "v").filter("u <> v")
    out = step.filter(F.col("u").isin(*ids)).select(F.col("u").alias("a"), F.col("v").alias("x")).distinct()
    into = step.filter(F.col("v").isin(*ids)).select(F.col("u").alias("y"), F.col("v").alias("b")).distinct()
    # a seed's neighbours are the neighbours of a seed, seen from either end: only their degrees count
    calm = degrees(relations, out.select(F.col("x").alias("id"))).filter(F.col("degree") <= hub).select("id")
    order = F.col("a") < F.col("b")
    one = out.withColumnRenamed("x", "b").filter(F.col("b").isin(*ids) & order).select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("nodes"))
    inner = out.join(calm, F.col("x") == F.col("id"), "left_semi")
    two = inner.join(into, F.col("x") == F.col("y")).filter(order & (F.col("x") != F.col("b"))).select("a", "b", F.lit(2).alias("hops"), F.array("a", "x", "b").alias("nodes"))
    last = into.join(calm, F.col("y") == F.col("id"), "left_semi")
    # both ends of a middle step stand next to a seed; all others go before the steps are made distinct
    middle = step.join(inner.select(F.col("x").alias("u")).distinct(), "u", "left_semi").join(last.select(F.col("y").alias("v")).distinct(), "v", "left_semi").select("u", "v").distinct()
    mid = middle.join(inner, F.col("u") == F.col("x")).join(last, F.col("v") == F.col("y"))
    simple = order & (F.col("x") != F.col("b")) & (F.col("y") != F.col("a"))
    three = mid.filter(simple).select("a", "b", F.lit(3).alias("hops"), F.array("a", "x", "y", "b").alias("nodes"))
    every = one.union(two).union(three)
    shortest = every.withColumn("least", F.min("hops").over(Window.partitionBy("a", "b"))).filter("hops = least").drop("least")
    return shortest.orderBy("a", "b", "nodes").limit(most_paths)


def path_facts(relations: DataFrame, paths: DataFrame, limit: int = 100, allowed: DataFrame | None = None) -> DataFrame:
    """The relations along paths; hops is the path's length."""
    steps = paths.select("hops", F.explode(F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.element_at("nodes", i).alias("u"), F.element_at("nodes", i + 1).alias("v")))).alias("s"))
    seen = undirected(scoped(relations, allowed)).join(steps.select("hops", "s.u", "s.v").distinct(), ["u", "v"])
    return _best(seen.groupBy(*FACT_KEY, "confidence").agg(F.min("hops").alias("hops")), limit)


def intersection(relations: DataFrame, ids: Sequence, limit: int = 100, allowed: DataFrame | None = None) -> DataFrame:
    """Relations between the seeds and whatever all of them are linked to."""
    to_seed = undirected(scoped(relations, allowed)).filter(F.col("v").isin(*ids) & ~F.col("u").isin(*ids))
    full = to_seed.groupBy("u").agg(F.count_distinct("v").alias("linked")).filter(F.col("linked") == len(set(ids))).select("u")
    return _best(to_seed.join(full, "u", "left_semi").select(*FACT_KEY, "confidence").distinct().withColumn("hops", F.lit(1)), limit)


def linked_to_all(relations: DataFrame, ids: Sequence) -> DataFrame:
    """Relational division: vertices linked to every seed, with their relations to them."""
    to_seed = undirected(relations).filter(F.col("v").isin(*ids) & ~F.col("u").isin(*ids))
    counts = to_seed.groupBy(F.col("u").alias("id")).agg(F.count_distinct("v").alias("linked"), F.count("*").alias("n_relations"))
    return counts.filter(F.col("linked") == len(set(ids))).select("id", "n_relations")


def aggregation(relations: DataFrame, vertices: DataFrame, ids: Sequence = (), predicate: str | None = None, kind: str | None = None, top: int = 10, allowed: DataFrame | None = None, samples: int = 5) -> DataFrame:
    """Vertices by distinct neighbours: entity_id, name, n, samples (the smallest fact keys). With a predicate only a
    vertex's own outgoing relations count; ``vertices`` has id, name and type."""
    rel = scoped(relations, allowed)
    pairs = rel.filter(F.col("predicate") == predicate).select(F.col("subject_id").alias("u"), F.col("object_id").alias("v"), "*") if predicate else undirected(rel)
    if ids:
        pairs = pairs.filter(F.col("v").isin(*ids) & ~F.col("u").isin(*ids))
    own = vertices if kind is None else vertices.filter(F.col("type") == kind)
    # distinct neighbours first, so the count is a plain sum over a pre-aggregated table
    near = pairs.groupBy("u", "v").agg(F.min(F.struct(*FACT_KEY)).alias("fact"))
    ranked = near.groupBy("u").agg(F.count("*").alias("n")).join(own.select(F.col("id").alias("u"), "name"), "u").orderBy(F.desc("n"), "name", "u").limit(top)
    order = Window.partitionBy("u").orderBy("fact")
    few = near.join(ranked.select("u"), "u", "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= samples)
    few = few.groupBy("u").agg(F.sort_array(F.collect_list("fact")).alias("samples"))
    return ranked.join(few, "u").select(F.col("u").alias("entity_id"), "name", "n", "samples").orderBy(F.desc("n"), "name", "entity_id")


# ---------- posts ----------


def seeded(posts: DataFrame, edges: DataFrame, ids: Sequence) -> DataFrame:
    """Posts that link to any seed; all posts without seeds."""
    return posts.join(edges.filter(F.col("dst").isin(*ids)).select(F.col("src").alias("post_id")).distinct(), "post_id", "left_semi") if ids else posts


def entity_posts(posts: DataFrame, edges: DataFrame, ids: Sequence, where: Column | None = None, limit: int = 100) -> DataFrame:
    """One row for each post, relation and seed, the newest first (undated posts before dated ones)."""
    kept = posts if where is None else posts.filter(where)
    found = edges.filter(F.col("dst").isin(*ids)).join(kept, F.col("src") == F.col("post_id")).select("post_id", "posted_at", "rel", "dst").distinct()
    return found.orderBy(F.desc_nulls_first("posted_at"), "post_id", "rel", "dst").limit(limit)


def post_context(edges: DataFrame, post_ids: Sequence, limit: int | None = None) -> DataFrame:
    """All that some posts link to."""
    found = edges.filter(F.col("src").isin(*post_ids)).select(F.col("src").alias("post_id"), "rel", "dst").distinct()
    return found if limit is None else found.orderBy("post_id", "rel", "dst").limit(limit)


def co_mentions(posts: DataFrame, edges: DataFrame, ids: Sequence, where: Column | None = None, limit: int = 100, relations: Sequence[str] = CO_RELATIONS, samples: int = 5) -> DataFrame:
    """What else appears in the posts of each seed: seed, dst, rel, n (distinct posts), samples (the smallest ids)."""
    kept = posts if where is None else posts.filter(where)
    of_seed = edges.filter(F.col("dst").isin(*ids)).select(F.col("dst").alias("seed"), "src").distinct()
    of_seed = of_seed.join(kept.select(F.col("post_id").alias("src")), "src", "left_semi")
    # only edges of the seeds' own posts are made distinct
    others = edges.filter(F.col("rel").isin(*relations) & ~F.col("dst").isin(*ids)).select("src", "dst", "rel").join(of_seed.select("src").distinct(), "src", "left_semi").distinct()
    pairs = of_seed.join(others, "src")
    top = pairs.groupBy("seed", "dst", "rel").agg(F.count("*").alias("n"), F.min("src").alias("first_post")).orderBy(F.desc("n"), "dst", "seed", "rel").limit(limit)
    order = Window.partitionBy("seed", "dst", "rel").orderBy("src")
    few = pairs.join(top.select("seed", "dst", "rel"), ["seed", "dst", "rel"], "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= samples)
    few = few.groupBy("seed", "dst", "rel").agg(F.sort_array(F.collect_list("src")).alias("samples"))
    return top.join(few, ["seed", "dst", "rel"]).orderBy(F.desc("n"), "dst", "seed", "rel")


def stance_counts(posts: DataFrame, edges: DataFrame, ids: Sequence, where: Column | None = None) -> DataFrame:
    """Distinct posts for each seed and stance, with the three smallest post ids."""
    kept = posts if where is None else posts.filter(where)
    rows = edges.filter((F.col("rel") == "STANCE") & F.col("dst").isin(*ids)).select("src", F.col("dst").alias("id"), "stance").distinct()
    rows = rows.join(kept.select(F.col("post_id").alias("src")), "src", "left_semi")
    order = Window.partitionBy("id", "stance").orderBy("src")
    counts = rows.groupBy("id", "stance").agg(F.count("*").alias("n"))
    few = rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").groupBy("id", "stance").agg(F.sort_array(F.collect_list("src")).alias("samples"))
    return counts.join(few, ["id", "stance"]).orderBy(F.desc("n"), "id", "stance")


def filtered_posts(posts: DataFrame, where: Column | None = None, limit: int = 8) -> DataFrame:
    kept = posts if where is None else posts.filter(where)
    return kept.select("post_id", "posted_at").orderBy(F.desc_nulls_first("posted_at"), "post_id").limit(limit)


def facet_nodes(posts: DataFrame, edges: DataFrame, vertices: DataFrame, rel: str, kind: str | None = None, where: Column | None = None, ids: Sequence = (), top: int | None = 10) -> DataFrame:
    """Posts by a linked vertex: id, name, n (distinct posts), sample_min, sample_max."""
    kept = seeded(posts if where is None else posts.filter(where), edges, ids).select(F.col("post_id").alias("src"))
    own = vertices if kind is None else vertices.filter(F.col("kind") == kind)
    links = edges.filter(F.col("rel") == rel).select("src", "dst").distinct().join(kept, "src", "left_semi")
    counts = links.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("sample_min"), F.max("src").alias("sample_max"))
    named = counts.join(own.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("dst").alias("id"), "name", "n", "sample_min", "sample_max")
    return named if top is None else named.orderBy(F.desc("n"), "name", "id").limit(top)


def facet_property(posts: DataFrame, edges: DataFrame, column: str, where: Column | None = None, ids: Sequence = (), top: int | None = 10) -> DataFrame:
    """Posts by one of their own columns; posts without a value are in no group."""
    kept = seeded(posts if where is None else posts.filter(where), edges, ids).filter(F.col(column).isNotNull())
    counts = kept.groupBy(F.col(column).cast("string").alias("name")).agg(F.count("*").alias("n"), F.min("post_id").alias("sample_min"), F.max("post_id").alias("sample_max"))
    return counts if top is None else counts.orderBy(F.desc("n"), "name").limit(top)


def facets(posts: DataFrame, edges: DataFrame, vertices: DataFrame, node_dims: dict[str, tuple[str, str, str | None]], columns: Sequence[str] = (), where: Column | None = None, ids: Sequence = (), top: int | None = 10) -> DataFrame:
    """The total and any number of facets from one plan: dim ("total" for the total), id (of a vertex; else null), name, n,
    sample_min, sample_max, place (1 .. top within the dim).

    node_dims: dim -> (label, relation, kind or None); columns: the posts' own. The total and all own columns are grouping
    sets of one aggregation, all linked vertices another one over the links of the posts that fit."""
    own = [c for c in columns if c not in node_dims]
    kept = seeded(posts if where is None else posts.filter(where), edges, ids)
    values = kept.select("post_id", *[F.col(c).cast("string").alias(f"by_{c}") for c in own])
    counts = [F.count("*").alias("n"), F.min("post_id").alias("sample_min"), F.max("post_id").alias("sample_max")]
    if own:
        names = [f"by_{c}" for c in own]
        sets = values.groupingSets([[], *[[c] for c in names]], *names).agg(F.grouping_id().alias("set"), *counts)
        # in the set of one column its bit is 0 and all others are 1
        full = (1 << len(own)) - 1
        bits = {c: full ^ (1 << (len(own) - 1 - i)) for i, c in enumerate(own)}
        cases = [F.when(F.col("set") == b, F.struct(F.lit(c).alias("dim"), F.col(f"by_{c}").alias("name"))) for c, b in bits.items()]
        sets = sets.select(F.coalesce(*cases, F.when(F.col("set") == full, F.struct(F.lit("total").alias("dim"), F.lit("matching posts").alias("name")))).alias("d"), "n", "sample_min", "sample_max")
        out = sets.filter("d.name IS NOT NULL").select("d.dim", F.lit(None).cast("string").alias("id"), "d.name", "n", "sample_min", "sample_max")
    else:
        out = values.agg(*counts).select(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("id"), F.lit("matching posts").alias("name"), "n", "sample_min", "sample_max")
    if node_dims:
        links = edges.filter(F.col("rel").isin(*sorted({rel for _, rel, _ in node_dims.values()}))).select("src", "dst", "rel").distinct().join(kept.select(F.col("post_id").alias("src")), "src", "left_semi")
        linked = links.groupBy("dst", "rel").agg(F.count("*").alias("n"), F.min("src").alias("sample_min"), F.max("src").alias("sample_max"))
        named = linked.join(vertices.select(F.col("id").alias("dst"), "name", "label", "kind"), "dst")
        fit = F.array_compact(F.array(*[F.when((F.col("label") == label) & (F.col("rel") == rel) & (F.lit(True) if kind is None else F.col("kind") == kind), F.lit(dim)) for dim, (label, rel, kind) in node_dims.items()]))
        out = out.unionByName(named.select(F.explode(fit).alias("dim"), F.col("dst").alias("id"), "name", "n", "sample_min", "sample_max"))
    placed = out.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "name", "id")))
    return placed if top is None else placed.filter(F.col("place") <= top)


def total(posts: DataFrame, edges: DataFrame, where: Column | None = None, ids: Sequence = ()) -> DataFrame:
    return seeded(posts if where is None else posts.filter(where), edges, ids).agg(F.count("*").alias("n"))


def entity_mentions(edges: DataFrame, post_ids: Sequence, ids: Sequence) -> DataFrame:
    """Distinct seeds each of some posts (or chunks) links to."""
    return edges.filter(F.col("src").isin(*post_ids) & F.col("dst").isin(*ids)).groupBy("src").agg(F.count_distinct("dst").alias("n"))


def choose_templates(ids: Sequence, query_type: str, hops: int) -> list[str]:
    """The patterns a question runs."""
    wanted = [
        ("neighbourhood", bool(ids)),
        ("two_hop", bool(ids) and (hops > 1 or query_type == "relationship")),
        ("path", len(ids) > 1),
        ("intersection", len(ids) > 1),
        ("aggregation", query_type == "aggregation"),
    ]
    return [name for name, use in wanted if use]
