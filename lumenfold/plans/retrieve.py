"""Retrieval over documents and posts: filtered vector search and graph patterns, fused, reranked and cut to a budget.

Everything up to the last few rows is a DataFrame; what is collected is bounded by the settings' limits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import filters as flt
from lumenfold.functions.text import ENTITY_TYPES, fact_text, plain_token_count, plain_words
from lumenfold.operators import fulltext, fusion, graph, templates, vectors
from lumenfold.plans import lexicon
from lumenfold.plans.analyze import Analysis, NameIndex, analyze_posts, document_filters, is_generic, language_of, time_filter
from lumenfold.settings import Settings

Scorer = Callable[[str, list[str]], list[float]]


def overlap_scorer(question: str, texts: list[str]) -> list[float]:
    """Offline stand-in for a relevance model, 0 .. 1: the share of the question's words that a text holds."""
    asked = {w for w in plain_words(question) if w not in lexicon.STOP}
    return [len(asked & set(plain_words(t))) / len(asked) if asked else 0.0 for t in texts]


def cosine_scorer(embed: Callable[[str], list[float]]) -> Scorer:
    """Where there is no relevance model: the inner product of unit vectors of the question and a text, at least 0."""

    def score(question: str, texts: list[str]) -> list[float]:
        asked = embed(question)
        return [max(0.0, sum(a * b for a, b in zip(asked, embed(t), strict=True))) for t in texts]

    return score


@dataclass
class Result:
    question: str
    mode: str
    analysis: Analysis
    chunks: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    aggregates: list[dict] = field(default_factory=list)
    templates: list[str] = field(default_factory=list)
    context_tokens: int = 0


def _fact_rows(found: DataFrame, template: str, hops: int | None = None) -> DataFrame:
    hop = F.col("hops").cast("int") if hops is None else F.lit(hops)
    return found.select("subject_id", "predicate", "object_id", hop.alias("hops"), "confidence", F.array(F.col("chunk_id").cast("string")).alias("chunk_ids"), F.lit(template).alias("template"))


def _fitting(spark: SparkSession, chunk_costs: list[int], fact_costs: list[int], budget: int) -> Row:
    """``fusion.within_budget`` for the final rows of one question."""
    listed = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    return spark.range(1).select(fusion.within_budget(listed(chunk_costs), listed(fact_costs), budget).alias("fit")).first()["fit"]


class DocumentEngine:
    """The document corpus: chunks (with embedding), relations, entities (id, name, type, aliases), mentions (chunk_id,
    entity_id)."""

    def __init__(self, chunks: DataFrame, relations: DataFrame, entities: DataFrame, mentions: DataFrame, embed: Callable[[str], list[float]], settings: Settings | None = None, scorer: Scorer | None = overlap_scorer, analyzer: Callable[[str], dict] | None = None, index: fulltext.StoredIndex | None = None):
        self.chunks, self.relations, self.entities, self.mentions, self.analyzer = chunks, relations, entities, mentions, analyzer
        self.embed, self.settings, self.scorer, self.index = embed, settings or Settings(), scorer, index

    def analyze(self, question: str, names: list[str] = (), query_type: str = "lookup", predicate: str | None = None, target_type: str | None = None, types: Sequence[str] = ENTITY_TYPES) -> Analysis:
        """An analysis from what an outside reader (``analyzer``: names, query_type, predicate, target_type; or the arguments)
        found in the question; names are resolved against the entities. Without a reader, or where it fails, the entities
        that the question's own words find best count."""
        from lumenfold.operators.extraction import entity_key

        document = doc_type = None
        if self.analyzer is not None and not names:
            try:
                read = self.analyzer(question)
                names, query_type, predicate, target_type = read.get("names", ()), read.get("query_type", query_type), read.get("predicate", predicate), read.get("target_type", target_type)
                types, document, doc_type = read.get("types", types), read.get("document"), read.get("doc_type")
            except Exception:  # noqa: BLE001  the reader is someone else's service; the question's words remain
                names = ()
        searchable = self.entities.select("id", "name", "type", F.concat_ws(" ", F.col("name"), F.array_join("aliases", " ")).alias("names"))
        out = Analysis(language_of(question), query_type, predicate=predicate, target_type=target_type, time=time_filter(question))
        if document or doc_type:
            kinds = [F.col(c) if c in self.chunks.columns else F.lit(None).cast("string").alias(c) for c in ("source", "doc_type")]
            out.filters = document_filters(question, [tuple(r) for r in graph.document_sources(self.chunks.select(*kinds)).collect()], document, doc_type)
        for name in names:
            if not is_generic(name) and (hit := fulltext.resolve(searchable, name, entity_key, types, index=self.index)):
                out.entities.append((hit["id"], hit["name"]))
        asked = [w for w in dict.fromkeys(plain_words(question)) if w not in lexicon.STOP]
        if not names and asked:
            found = fulltext.bm25(searchable, asked, "id", "names", self.settings.seed_entities) if self.index is None else self.index.search(asked, self.settings.seed_entities)
            hits = fulltext.near_best(found).join(self.entities.select("id", "name"), "id")
            out.entities = [(r["id"], r["name"]) for r in hits.orderBy(F.desc("score"), "id").collect()]
        return out

    def relaxed(self, analysis: Analysis, explicit: dict[str, str], asked_time: flt.TimeFilter | None = None) -> Analysis:
        """Without a matching chunk the time goes first, then all inferred filters at once; explicit ones stay, a time that
        was asked for too."""
        own = {**analysis.filters, **explicit}
        inferred = None if asked_time else analysis.time
        tests = {"time": flt.conjunction(flt.overlaps(inferred)), "rest": flt.conjunction(flt.exact(self.chunks, {k: v for k, v in own.items() if k not in explicit})), "fixed": flt.conjunction(flt.exact(self.chunks, explicit) + flt.overlaps(asked_time))}
        steps = [["time", "rest", "fixed"], ["rest", "fixed"], ["fixed"]] if own or analysis.time else [["fixed"]]
        kept = flt.first_that_matches(self.chunks, tests, steps)
        return replace(analysis, filters=own if "rest" in kept else dict(explicit), time=asked_time or (analysis.time if "time" in kept else None), dropped=[n for n in ("time", "rest") if n not in kept and own])

    def facts(self, analysis: Analysis, hops: int, allowed: DataFrame | None) -> tuple[DataFrame | None, list[dict], list[str]]:
        s, rel, ids = self.settings, self.relations, analysis.ids
        names, found, counts = templates.choose_templates(ids, analysis.query_type, hops), [], []
        for name in names:
            if name == "neighbourhood":
                found.append(_fact_rows(templates.neighbourhood(rel, ids, s.graph_fact_limit, allowed), name))
            elif name == "two_hop":
                found.append(_fact_rows(templates.two_hop(rel, ids, s.hub_degree_limit, s.graph_fact_limit, allowed), name))
            elif name == "path":
                found.append(_fact_rows(templates.path_facts(rel, templates.shortest_paths(rel, ids, s.hub_degree_limit), s.graph_fact_limit, allowed), name))
            elif name == "intersection":
                found.append(_fact_rows(templates.intersection(rel, ids, s.graph_fact_limit, allowed), name))
            else:
                top = templates.aggregation(rel, self.entities, ids, analysis.predicate, analysis.target_type, allowed=allowed)
                counts = [r.asDict() for r in top.select("entity_id", "name", "n").collect()]
                samples = top.select(F.explode("samples").alias("f")).select("f.*").join(rel, list(templates.FACT_KEY)).select(*templates.FACT_KEY, "confidence")
                found.append(_fact_rows(samples, name, 1))
        if not found:
            return None, counts, names
        rows = found[0]
        for f in found[1:]:
            rows = rows.unionByName(f)
        return rows, counts, names

    def retrieve(self, question: str, mode: str = "hybrid", analysis: Analysis | None = None, top_k: int | None = None, hops: int = 2, explicit: dict[str, str] | None = None, date_from: date | None = None, date_to: date | None = None) -> Result:
        s, explicit = self.settings, explicit or {}
        top_k = top_k or s.top_k
        asked_time = flt.TimeFilter(date_from, date_to) if date_from or date_to else None
        # vector mode reads nothing out of the question
        analysis = replace(analysis or Analysis(language_of(question)), filters={}, time=None) if mode == "vector" else analysis or self.analyze(question)
        analysis = self.relaxed(analysis, explicit, asked_time)
        tests = flt.exact(self.chunks, analysis.filters) + flt.overlaps(analysis.time)
        where = flt.conjunction(tests) if tests else None
        out = Result(question, mode, analysis)
        hits = None
        if mode in ("vector", "hybrid"):
            found = vectors.search(self.chunks, self.embed(question), s.candidate_pool, where)
            hits = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
        if mode == "hybrid" and not analysis.entities and analysis.query_type == "relationship":
            near = hits.filter(F.col("rank") <= s.seed_chunks).select("chunk_id", (F.col("rank") - 1).alias("chunk_rank"))
            seeds = fusion.seed_entities(graph.entities_in_chunks(self.mentions, self.relations, near, s.hub_degree_limit), s.seed_entities)
            analysis.entities = [(r["entity_id"], r["entity_id"]) for r in seeds.collect()]
        ranked: list[dict] = []
        if mode in ("graph", "hybrid"):
            allowed = graph.chunks_matching(self.chunks, where) if where is not None else None
            rows, out.aggregates, out.templates = self.facts(analysis, hops, allowed)
            ranked = self._ranked(rows, question, analysis) if rows is not None else []
        self._assemble(out, hits, ranked, top_k)
        return out

    def _ranked(self, rows: DataFrame, question: str, analysis: Analysis) -> list[dict]:
        named = lambda c, n: self.entities.select(F.col("id").alias(c), F.col("name").alias(n))
        # a template's facts are few; their evidence and their chunks' sources are looked up behind its limit
        evidence = F.col("evidence") if "evidence" in self.relations.columns else F.lit(None).cast("string")
        said = self.relations.select(*templates.FACT_KEY, evidence.alias("evidence")).dropDuplicates(list(templates.FACT_KEY))
        few = rows.withColumn("chunk_id", F.element_at("chunk_ids", 1)).join(said.withColumn("chunk_id", F.col("chunk_id").cast("string")), list(templates.FACT_KEY), "left")
        of_chunk = self.chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source") if "source" in self.chunks.columns else F.lit(None).cast("string").alias("source"))
        few = few.join(of_chunk, "chunk_id", "left").withColumn("sources", F.array_compact(F.array("source"))).withColumn("seq", F.struct("hops", "chunk_id"))
        merged = fusion.dedupe_facts(few).join(named("subject_id", "subject"), "subject_id").join(named("object_id", "object"), "object_id")
        rows_ = [r.asDict() for r in merged.withColumn("text", fact_text(F.col("subject"), F.col("predicate"), F.col("object"))).collect()]  # bounded by the templates' limits
        if not rows_:
            return []
        spark = rows.sparkSession
        if self.scorer is None:
            ordered = sorted(rows_, key=lambda f: (f["hops"], -f["confidence"], -len(f["chunk_ids"]), f["text"]))
            return ordered
        scores = self.scorer(question, [f"{f['subject']} {f['predicate'].lower().replace('_', ' ')} {f['object']}" for f in rows_])
        scored = spark.createDataFrame([(f["subject_id"], f["predicate"], f["object_id"], round(float(x), 4)) for f, x in zip(rows_, scores, strict=True)], "subject_id string, predicate string, object_id string, relevance double")
        final = fusion.rank_facts(merged.join(F.broadcast(scored), list(fusion.KEY)), analysis.predicate).select(*fusion.KEY, "rank", "score", "relevance").collect()
        place = {(r["subject_id"], r["predicate"], r["object_id"]): r for r in final}
        return [f | {"relevance": place[k]["relevance"], "score": place[k]["score"]} for f in sorted(rows_, key=lambda f: place[f["subject_id"], f["predicate"], f["object_id"]]["rank"]) if (k := (f["subject_id"], f["predicate"], f["object_id"])) in place]

    def _assemble(self, out: Result, hits: DataFrame | None, ranked: list[dict], top_k: int) -> None:
        s, spark = self.settings, self.chunks.sparkSession
        support: dict[str, list[int]] = {}
        for at, f in enumerate(ranked):
            for c in f["chunk_ids"]:
                support.setdefault(c, []).append(at)
        order = sorted(support, key=lambda c: (support[c][0], -len(support[c]), c))[: s.candidate_pool]
        linked = spark.createDataFrame([(c, i) for i, c in enumerate(order, 1)], "chunk_id string, rank int")
        found = (hits if hits is not None else self.chunks.limit(0).withColumn("rank", F.lit(0))).select("chunk_id", "rank")
        mentioned = None
        if out.analysis.ids:
            mentioned = self.mentions.filter(F.col("entity_id").isin(*out.analysis.ids)).groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("n"))
        fused = fusion.reciprocal_rank_fusion(found, linked, mentioned, s.rrf_k, s.mention_boost).filter(F.col("fused_rank") <= s.candidate_pool)
        pool = [r.asDict() for r in fused.join(self.chunks.drop("embedding"), "chunk_id").orderBy("fused_rank").collect()]
        if self.scorer and pool:
            for c, x in zip(pool, self.scorer(out.question, [c["text"] for c in pool]), strict=True):
                c["rerank"] = round(float(x), 4)
            pool.sort(key=lambda c: -c["rerank"])
        pool = pool[:top_k]
        fit = _fitting(spark, [c.get("token_count") or plain_token_count(c["text"]) for c in pool], [plain_token_count(f["text"]) for f in ranked], s.context_tokens)
        out.chunks, out.facts, out.context_tokens = [pool[i] for i in fit["chunks"]], [ranked[i] for i in fit["facts"]], fit["used"]


class PostEngine:
    """The post corpus: posts (flat filter columns, see ``flat_posts``), edges, vertices, and chunks for vector search."""

    def __init__(self, posts: DataFrame, edges: DataFrame, vertices: DataFrame, chunks: DataFrame, embed: Callable[[str], list[float]], settings: Settings | None = None, scorer: Scorer | None = overlap_scorer):
        self.posts, self.edges, self.vertices, self.chunks = flat_posts(posts), edges, vertices, chunks
        self.embed, self.settings, self.scorer = embed, settings or Settings(), scorer
        self.index = NameIndex(vertices, edges)

    def tests(self, analysis: Analysis) -> dict:
        column = {"district": "districts", "thana": "thanas", "category": "categories", "sub_category": "sub_categories"}
        out = {k: F.array_contains(column[k], v) if k in column else F.col(k) == v for k, v in analysis.filters.items()}
        if analysis.time:
            out["time"] = flt.conjunction(flt.posted_within(analysis.time))
        return out

    def relaxed(self, analysis: Analysis, explicit: dict[str, str], fixed: tuple[str, ...] = ()) -> tuple[Analysis, list]:
        analysis = replace(analysis, filters={**analysis.filters, **explicit})
        tests = self.tests(analysis)
        kept = flt.first_that_matches(self.posts, tests, flt.levels(list(tests), fixed=frozenset((*explicit, *fixed))))
        slim = replace(analysis, filters={k: v for k, v in analysis.filters.items() if k in kept}, time=analysis.time if "time" in kept else None, dropped=[k for k in tests if k not in kept])
        return slim, [tests[k] for k in kept]

    def counts(self, analysis: Analysis, where) -> list[dict]:
        """The total and up to two facets."""
        dims = analysis.group_by or (["sub_category"] if "district" in analysis.filters else ["district"])
        top, ids = min(analysis.top_n or 10, 25), analysis.ids
        nodes = {d: lexicon.NODE_FACETS[d] for d in dims[:2] if d in lexicon.NODE_FACETS}
        found = templates.facets(self.posts, self.edges, self.vertices, nodes, [d for d in dims[:2] if d not in nodes], where, ids, top).collect()  # 1 + 2 * 25 rows at most
        order = {"total": 0, **{d: i for i, d in enumerate(dims[:2], 1)}}
        out = [{"dim": r["dim"], "name": r["name"], "n": r["n"], "samples": [] if r["dim"] == "total" else [r["sample_min"], r["sample_max"]]} for r in sorted(found, key=lambda r: (order[r["dim"]], r["place"]))]
        return out

    def _names(self, ids: Sequence[str]) -> dict[str, str]:
        """What posts and vertices are called: a post by its author or platform and its day, a vertex by its name."""
        asked = sorted(set(map(str, ids)))
        if not asked:
            return {}
        value = lambda c: F.col(c) if c in self.posts.columns else F.lit(None).cast("string")
        who = F.coalesce(F.concat(F.lit("@"), value("author")), value("platform"), F.lit("post"))
        post = F.concat(F.lit("Post "), F.col("post_id").cast("string"), F.lit(" ("), who, F.lit(", "), F.coalesce("date", F.lit("undated")), F.lit(")"))
        rows = self.posts.filter(F.col("post_id").isin(*asked)).select(F.col("post_id").cast("string").alias("id"), post.alias("name"))
        posts, others = rows.collect(), self.vertices.filter(F.col("id").isin(*asked)).select("id", "name").collect()
        return {i: i for i in ids} | {r["id"]: r["name"] for r in (*others, *posts) if r["name"]}

    def _named(self, rows: list[tuple]) -> list[dict]:
        """Facts of (template, subject, predicate, object or None, posts, number of posts or None) with names for ids."""
        names = self._names([x for _, s, _, o, _, _ in rows for x in (s, o) if x is not None])
        called = lambda o, n: f"{n} posts" if o is None else names[o] + (f" ({n} posts)" if n is not None else "")
        return [{"text": f"{names[s]} -[{p}]-> {called(o, n)}", "subject": names[s], "predicate": p, "object": called(o, n), "chunk_ids": posts, "template": t} for t, s, p, o, posts, n in rows]

    def _in_order(self, question: str, facts: list[dict]) -> list[dict]:
        """Counts as they were counted, then the others by relevance (of ties as they were found)."""
        counts, rest = [f for f in facts if f["template"] == "count"], [f for f in facts if f["template"] != "count"]
        if self.scorer and rest:
            for f, x in zip(rest, self.scorer(question, [f["text"] for f in rest]), strict=True):
                f["relevance"] = round(float(x), 4)
            rest.sort(key=lambda f: -f["relevance"])
        return counts + rest

    def retrieve(self, question: str, mode: str = "hybrid", top_k: int | None = None, explicit: dict[str, str] | None = None, today=None, date_from: date | None = None, date_to: date | None = None) -> Result:
        s, explicit = self.settings, explicit or {}
        asked_time = flt.TimeFilter(date_from, date_to) if date_from or date_to else None
        read = analyze_posts(question, self.index, today)
        analysis, tests = self.relaxed(replace(read, time=asked_time) if asked_time else read, explicit, fixed=("time",) if asked_time else ())
        where = flt.conjunction(tests) if tests else None
        out = Result(question, mode, analysis)
        allowed = self.posts if where is None else self.posts.filter(where)
        facts: list[dict] = []
        if mode in ("graph", "hybrid"):
            if analysis.query_type == "aggregation":
                out.aggregates, out.templates = self.counts(analysis, where), ["count"]
                facts += [{"text": f"{a['name']} -[MATCHING_POSTS]-> {a['n']} posts", "chunk_ids": a["samples"], "template": "count"} for a in out.aggregates]
            if analysis.ids:
                rows = [("entity_posts", r["post_id"], r["rel"], r["dst"], [r["post_id"]], None) for r in templates.entity_posts(self.posts, self.edges, analysis.ids, where, 60).collect()]
                rows += [("co_mentions", r["seed"], lexicon.CO_PREDICATES[r["rel"]], r["dst"], list(r["samples"]), r["n"]) for r in templates.co_mentions(self.posts, self.edges, analysis.ids, where, 60).collect()]
                rows += [("stance_counts", r["id"], f"STANCE_{r['stance'].upper()}", None, list(r["samples"]), r["n"]) for r in templates.stance_counts(self.posts, self.edges, analysis.ids, where).collect()]
                facts += self._named(rows)
                out.templates += ["entity_posts", "co_mentions", "stance_counts"]
            elif tests and analysis.query_type != "aggregation":
                found = [r["post_id"] for r in templates.filtered_posts(self.posts, where, 8).collect()]
                names = self._names(found)
                facts += [{"text": names[p], "chunk_ids": [p], "template": "filtered_posts"} for p in found]
                out.templates.append("filtered_posts")
        facts = self._in_order(question, facts)
        order = list(dict.fromkeys(c for f in facts for c in f["chunk_ids"]))[: s.candidate_pool]
        spark = self.posts.sparkSession
        linked = spark.createDataFrame([(c, i) for i, c in enumerate(order, 1)], "chunk_id string, rank int")
        hits = self.chunks.limit(0).select("chunk_id").withColumn("rank", F.lit(0))
        if mode in ("vector", "hybrid"):
            near = vectors.search(self.chunks.join(allowed.select(F.col("post_id").alias("chunk_id")), "chunk_id", "left_semi"), self.embed(question), s.candidate_pool)
            hits = near.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank"))
        fused = fusion.reciprocal_rank_fusion(hits, linked, None, s.rrf_k, s.mention_boost).filter(F.col("fused_rank") <= s.candidate_pool)
        pool = [r.asDict() for r in fused.join(self.chunks.drop("embedding"), "chunk_id").orderBy("fused_rank").collect()]
        if self.scorer and pool:
            for c, x in zip(pool, self.scorer(question, [c["text"] for c in pool]), strict=True):
                c["rerank"] = round(float(x), 4)
            pool.sort(key=lambda c: -c["rerank"])
        pool = pool[: top_k or s.top_k]
        fit = _fitting(spark, [plain_token_count(c["text"]) for c in pool], [plain_token_count(f["text"]) for f in facts], s.post_context_tokens)
        out.chunks, out.facts, out.context_tokens = [pool[i] for i in fit["chunks"]], [facts[i] for i in fit["facts"]][: s.post_facts], fit["used"]
        return out


def flat_posts(posts: DataFrame) -> DataFrame:
    """Posts with the names of their districts, stations and categories as arrays, and their day."""
    arrays = [c for c in ("districts", "thanas", "categories", "sub_categories") if dict(posts.dtypes).get(c, "").startswith("array<struct")]
    flat = posts.withColumns({c: F.transform(F.col(c), lambda r: r["name"]) for c in arrays})
    return flat.withColumn("date", F.date_format("posted_at", "yyyy-MM-dd"))
