"""Exact top-k inner-product search by a three-phase uniform threshold.

Each vector's components are split into slices; a slice gives one score list a query, and a candidate's score is the sum
over its lists. Vectors are dealt to blocks by bands of their norm. Phase 1 gathers the lists' highest entries in every
``stride``-th block, from the highest norms down, and completes their scores: the k-th highest of them is a safe cutoff, for
the k-th highest of all can't be lower. Phase 2 covers all blocks but those of bands whose norms can't reach a query's
cutoff: no product is made there. It hands cutoff / slices back to all lists: a candidate that reaches the cutoff must reach that share in
one list at least, so the entries above it suffice. Phase 3 resolves these candidates' remaining scores exactly, in the
block that holds them, and passes on what reaches the cutoff.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written
from lumenfold.llm.merkle import numbered


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    for i, v in enumerate(col):
        out[i, : len(v)] = v
    return out


def _numbered(n: int):
    """A row for each of the blocks 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one class: its key, smallest id, vector and k + 1 smallest ids (no query needs more of them), each with
    how often it stands there.

    The ids are ranked behind a partial limit, so a class that holds a third of all rows sends a few from each partition."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("rn") <= k + 1)
    return ranked.groupBy("key").agg(F.min("id").alias("least"), F.first("v").alias("v"), F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))


def exact_top_k(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "v", slices: int = 4, query_block: int = 2048, candidate_block: int = 8192, stride: int = 4
) -> DataFrame:
    """``query_id, rank, id, score``: each query's k highest integer inner products with other rows' vectors.

    ``vectors`` holds integer vectors; ``is_query`` is a condition on its rows. Ties go to the smaller id; a query is no
    candidate of its own. Rows with a null id or vector take no part, shorter vectors count as padded with zeros, very long ones
    are multiplied whole, an empty table gives no rows. A candidate that stands several times fills as many ranks; an id that
    asks several times, with one vector or with more, gets the best of all its pairs, each as often as it is asked for. Products must stay below 2**53 (doubles are exact there).
    Queries against candidates run in blocks of fixed size, so no task or broadcast grows with the table; at most 64 bands of
    norms are told apart. ``stride`` changes the work, never the result.
    """
    base = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    keyed = base.withColumn("key", F.sha2(F.array_join("v", ","), 256)).groupBy("id", "key")
    base = written(keyed.agg(F.first("v").alias("v"), F.count("*").alias("n"), F.count_if("q").alias("asks")), "topk-rows")
    classes = numbered(_classes(base.select("id", "v", "key", "n"), k).withColumn("part", F.lit("")), "part", ["least", "key"], "topk")
    classes = written(classes.select(F.col("at").alias("cid"), "key", "v", "members"), "topk-classes")  # classes in the order of their smallest ids
    queries = base.filter("asks > 0").select(F.col("id").alias("query_id"), "key", "asks")
    # so many of the best classes can hold rows of the query's id alone
    wide = k + (base.groupBy("id").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).filter("asks > 0").agg(F.max("n")).first()[0] or 1)
    asked = written(queries.select("key").distinct().join(classes.select("key", F.col("cid").alias("qid"), F.col("v").alias("qv")), "key"), "topk-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x, F.lit(0.0))))
    counts = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    n_q = asked.count()
    dim = max(1, counts["d"])
    q_blocks = max(1, -(-n_q // query_block))
    # bands run from the highest norms (0) down; each has as many blocks as its vectors fill
    n_bands = max(1, min(64, -(-counts["n"] // candidate_block)))
    edges = classes.agg(F.percentile_approx(norm, [1 - i / n_bands for i in range(1, n_bands)], 1000)).first()[0] or [] if n_bands > 1 else []
    banded = classes.withColumn("norm", norm)
    band = sum((F.when(F.col("norm") < e, 1).otherwise(0) for e in edges), F.lit(0))
    sizes = {r["band"]: r for r in banded.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    filled = [-(-sizes[b]["n"] // candidate_block) if b in sizes else 0 for b in range(n_bands)]
    first = [sum(filled[:b]) for b in range(n_bands)]
    n_blocks = max(1, sum(filled))
    firsts, counted = (F.array(*[F.lit(x) for x in xs]) for xs in (first, filled))
    # double precision rounds: the bound is widened a little, so that nothing that reaches the cutoff is passed over
    tops = F.array(*[F.lit((sizes[b]["top"] if b in sizes else 0.0) * (1 + 1e-9)) for b in range(n_bands)])
    parts = np.array_split(np.arange(dim), min(slices, dim))

    def blocked(cutoff: DataFrame | None, mode: str, schema: str):
        """Runs a phase over all pairs of blocks: ``lists`` gives each slice's highest entries, ``above`` what reaches the
        cutoff."""

        def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "slice": pd.Series(dtype="int32"), "cid": pd.Series(dtype="int64"), "part": pd.Series(dtype="int64")})
            if not len(left) or not len(right):
                return empty
            cids, qids, c, q = left.cid.to_numpy(), right.qid.to_numpy(), _matrix(left.v, dim), _matrix(right.qv, dim)
            found = []
            for at in range(0, len(qids), 256):  # bounds the score matrices
                qa, ids = q[at : at + 256], qids[at : at + 256]
                lists = [qa[:, p] @ c[:, p].T for p in parts]
                if mode == "lists":
                    top = min(wide, len(cids))
                    for j, s in enumerate(lists):
                        best = np.argpartition(-s, top - 1, axis=1)[:, :top]
                        found.append((np.repeat(ids, top), np.full(best.size, j, "int32"), cids[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
                else:
                    cut = right.cutoff.to_numpy()[at : at + 256, None]
                    share = cut / len(parts)
                    enough = lists[0] >= share
                    for s in lists[1:]:
                        enough |= s >= share
                    qi, ci = np.nonzero(enough)
                    # what these candidates lack from the other lists lies in the same block: no entry has to travel for it
                    score = sum(s[qi, ci] for s in lists)
                    at_cut = score >= cut[qi, 0]
                    qi, ci = qi[at_cut], ci[at_cut]
                    found.append((ids[qi], np.full(len(qi), -1, "int32"), cids[ci], score[at_cut]))
            qid, sl, cid, part = (np.concatenate(x) for x in zip(*found, strict=True))
            return pd.DataFrame({"qid": qid, "slice": sl, "cid": cid, "part": part.astype("int64")})

        within = F.pmod(F.xxhash64("key"), F.get(counted, "band").cast("long"))
        left = banded.withColumn("band", band).select("cid", "v", (F.get(firsts, "band") + within).alias("cb"))
        right = asked.select("qid", "qv", F.pmod(F.xxhash64("key"), F.lit(q_blocks)).alias("qb"))
        if cutoff is None:
            left = left.filter(F.col("cb") % stride == 0)
            right = right.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"), F.lit(stride).cast("long"))))
        else:
            q_norm = F.sqrt(F.aggregate("qv", F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double") * x, F.lit(0.0))))
            reach = F.filter(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: (F.get(counted, b) > 0) & (F.col("q_norm") * F.get(tops, b) >= F.col("cutoff")))
            right = right.join(cutoff, "qid").withColumn("q_norm", q_norm).withColumn("band", F.explode(reach)).drop("q_norm")
            low = F.get(firsts, "band").cast("long")
            right = right.withColumn("cb", F.explode(F.sequence(low, low + F.get(counted, "band") - 1))).drop("band")
        left = left.withColumn("qb", _numbered(q_blocks))
        return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(work, schema)

    schema = "qid long, slice int, cid long, part long"

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked.select("qid", "qv"), "qid").join(classes.select("cid", "v"), "cid")
        dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
        return both.select("qid", "cid", dot.alias("score"))

    # phase 1: each list's highest entries, completed
    lists = blocked(None, "lists", schema)
    heads = lists.withColumn("rn", F.row_number().over(Window.partitionBy("qid", "slice").orderBy(F.desc("part"), "cid"))).filter(F.col("rn") <= wide)
    heads = scored(heads.select("qid", "cid").distinct())
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    nth = heads.withColumn("rn", F.row_number().over(by_score)).filter(F.col("rn") == wide).select("qid", F.col("score").cast("double").alias("cutoff"))
    # a query with fewer candidates than that has no cutoff: all of them are resolved
    cutoff = asked.select("qid").join(nth, "qid", "left").select("qid", F.coalesce("cutoff", F.lit(-1e300)).alias("cutoff"))
    cutoff = written(cutoff, "topk-cutoff")
    # phases 2 and 3
    above = blocked(cutoff, "above", schema).select("qid", "cid", F.col("part").alias("score"))
    best = above.withColumn("rn", F.row_number().over(by_score)).filter(F.col("rn") <= wide)
    best = best.join(classes.select("cid", "members"), "cid").join(asked.select("qid", "key"), "qid").select("key", "score", F.explode("members").alias("m"))
    # every pair once a key: a query and a class meet once for each key of the query's id
    pairs = queries.join(best, "key").filter(F.col("m.id") != F.col("query_id")).withColumn("id", F.col("m.id"))
    times = F.least(F.lit(k).cast("long"), F.col("m.n") * F.col("asks"))
    pairs = pairs.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("query_id", "id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score").withColumnRenamed("id", id_col)


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, v``: floor(scale * component) as integers; vectors that are null or hold null or non-finite components go."""
    x = F.col(vector_col)
    sound = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embeddings.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
