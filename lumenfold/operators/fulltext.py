"""Full-text search by BM25: over a table's rows, or over a stored inverted index of which a question reads its terms' buckets
alone."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import plain_search_words, search_words, words
from lumenfold.scratch import written


def _times(term: str):
    return F.size(F.filter("terms", lambda w: w == F.lit(term)))


def bm25(rows: DataFrame, query: Sequence[str], id_col: str, text_col: str, limit: int = 10, k1: float = 1.2, b: float = 0.75, all_terms: bool = False) -> DataFrame:
    """Rows by BM25 score: id, score (6 digits), terms (query terms found).

    Only rows with a query term are indexed further; lengths and document frequencies come from one pass, as one row of
    numbers that joins back without a shuffle."""
    terms = list(dict.fromkeys(query))
    split = rows.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("terms"))
    counted = split.select("id", F.size("terms").alias("length"), *[_times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    both = counted.filter(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0).join(F.broadcast(stats))
    score, found = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        found = found + F.when(tf > 0, 1).otherwise(0)
    out = both.select("id", F.round(score, 6).alias("score"), found.cast("long").alias("terms"))
    if all_terms:
        out = out.filter(F.col("terms") == len(terms))
    return out.orderBy(F.desc("score"), "id").limit(limit)


def _term_counts(rows: DataFrame) -> DataFrame:
    """Adds ``terms`` (term, tf) to rows with sorted ``words``. Equal words stand side by side, so a row's work follows its
    length, not the product of its words and its different words."""
    heads = F.filter(F.transform("words", lambda w, i: F.when(~w.eqNullSafe(F.get("words", i - 1)), i)), lambda i: i.isNotNull())
    ends = lambda k: F.coalesce(F.get("heads", k + 1), F.size("words"))
    counted = F.transform("heads", lambda at, k: F.struct(F.get("words", at).alias("term"), (ends(k) - at).alias("tf")))
    return rows.withColumn("heads", heads).withColumn("terms", counted).drop("heads")


class StoredIndex:
    """An inverted index kept in a store's tables, by source of the texts.

    ``<name>_postings`` (term, id, tf, length) lies in buckets of the term, ``<name>_texts`` (id, source, length, terms) in
    buckets of the source, ``<name>_stats`` is one row. An update reads the texts of its sources, takes their postings back
    and puts the new ones in; only buckets of terms that either has are written. Words are folded (``search_words``)."""

    def __init__(self, store, name: str, buckets: int = 64):
        self.store, self.name, self.buckets = store, name, buckets

    def replace(self, rows: DataFrame, sources: DataFrame | None = None) -> None:
        """The index with ``rows`` (id, source, text) in place of all rows of their sources, and of ``sources`` (source)."""
        split = rows.select(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.sort_array(search_words(F.coalesce("text", F.lit("")))).alias("words"))
        fresh = written(_term_counts(split).select("id", "source", F.size("words").alias("length"), "terms"), "index-texts")
        gone = fresh.select("source") if sources is None else fresh.select("source").union(sources.select(F.col("source").cast("string")))
        gone = written(gone.distinct(), "index-sources")
        with self.store.transaction():
            texts = f"{self.name}_texts"
            old = self.store.read(texts)
            old = None if old is None else written(old.join(gone, "source", "left_semi"), "index-old")
            keep = lambda was: fresh if was is None else was.join(gone, "source", "left_anti").unionByName(fresh)
            self.store.rewrite(texts, gone, keep, ["source"], self.buckets)
            new = fresh.select("id", "length", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "length")
            touched = new.select("term") if old is None else new.select("term").union(old.select(F.explode("terms.term").alias("term")))
            ids = None if old is None else old.select("id").distinct()
            merged = lambda was: new if was is None or ids is None else was.join(ids, "id", "left_anti").unionByName(new)
            self.store.rewrite(f"{self.name}_postings", touched, merged, ["term"], self.buckets)
            stats = self.store.read(texts).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
            self.store.write(f"{self.name}_stats", stats)

    def search(self, terms: Sequence[str], limit: int | None = 10, all_terms: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``id``, ``score`` (6 digits) and ``terms`` (how many of the asked ones) by BM25. Documents and lengths come from the
        postings of the asked terms; counts of documents are one row a term."""
        asked = list(dict.fromkeys(w for t in terms for w in plain_search_words(t)))
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in asked})
        snapshot = self.store.snapshot()
        found = snapshot.read(f"{self.name}_postings", buckets)
        if found is None or not asked:
            return self.store.spark.createDataFrame([], "id string, score double, terms long")
        hits = found.filter(F.col("term").isin(*asked))
        df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # a row for each asked term
        both = hits.join(df, "term").join(F.broadcast(snapshot.read(f"{self.name}_stats")))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
        out = both.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("terms"))
        out = out.filter(F.col("terms") == len(asked)) if all_terms else out
        return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def near_best(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """Hits with at least a share of the best score."""
    best = hits.agg(F.max("score").alias("best"))
    return hits.join(F.broadcast(best)).filter(F.col("score") >= share * F.col("best")).drop("best")


def resolve(entities: DataFrame, name: str, key, types: Sequence[str] = (), coverage: float = 0.6, index: StoredIndex | None = None):
    """The one entity (id, name, type, names: its name and aliases as one text) that a name means, or None.

    All words must be found; an exact key wins by the order of types, a single hit is taken, several are ambiguous. Failing
    that, a hit with most of the words is taken. ``key`` maps a name and a type to its comparison key. With a stored index,
    hits come from its postings and their entities are looked up by id."""
    from lumenfold.functions.text import plain_words

    query = (plain_words if index is None else plain_search_words)(name)
    if not query:
        return None
    for every in (True, False):
        found = bm25(entities, query, "id", "names", 10, all_terms=every) if index is None else index.search(query, 10, all_terms=every)
        hits = found.join(entities.select("id", "name", "type"), "id").orderBy(F.desc("score"), "id").collect()
        if not hits:
            continue
        exact = sorted((h for h in hits if key(h["name"], h["type"]) == key(name, h["type"])), key=lambda h: (types.index(h["type"]) if h["type"] in types else len(types), h["id"]))
        if exact:
            return exact[0]
        if every:
            return hits[0] if len(hits) == 1 else None
        return hits[0] if hits[0]["terms"] >= coverage * len(query) else None
    return None
