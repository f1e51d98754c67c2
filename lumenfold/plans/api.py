"""The engine's calls as one object: ingest, retrieve, query, jobs, stats, health. No server: these are plain methods."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import cache_key
from lumenfold.operators.vectors import HashedEmbedder
from lumenfold.plans.answer import Answer, AnswerEngine, LanguageModel, extractive
from lumenfold.plans.ingest import Report, Store, entity_index, ingest_documents, ingest_dump
from lumenfold.plans.retrieve import DocumentEngine, PostEngine, Result
from lumenfold.settings import Settings
from lumenfold.sources.files import load_files

JOBS = "id string, kind string, status string, stage string, seconds double, report string"


def valid_metadata(text: str | None) -> dict:
    """User metadata: a JSON object of plain values, or an error."""
    found = json.loads(text or "{}")
    if not isinstance(found, dict) or any(not isinstance(v, str | int | float | bool) for v in found.values()):
        raise ValueError("metadata has to be a JSON object of plain values")
    return found


class Cache:
    """Results of slow calls by the key of their inputs, as a stored table: hits are joined, misses are computed once."""

    def __init__(self, store: Store, name: str = "cache"):
        self.store, self.name = store, name

    def through(self, rows: DataFrame, inputs: list[str], compute: Callable[[DataFrame], DataFrame], out_col: str = "value") -> DataFrame:
        """``rows`` with ``out_col``: from the table where it is known, else from ``compute`` (rows -> rows with out_col)."""
        keyed = rows.withColumn("__key", cache_key(*[F.col(c) for c in inputs]))
        known = self.store.read(self.name)
        if known is None:
            known = self.store.spark.createDataFrame([], "__key string, value string")
        missing = compute(keyed.join(known.select("__key"), "__key", "left_anti").dropDuplicates(["__key"])).select("__key", F.col(out_col).cast("string").alias("value"))
        held = self.store.write(self.name, known.unionByName(missing))
        return keyed.join(held.withColumnRenamed("value", out_col), "__key").drop("__key")


class Engine:
    """One store with its two corpora."""

    def __init__(self, store: Store, model: LanguageModel = extractive, embed=None, settings: Settings | None = None):
        self.store, self.model, self.settings = store, model, settings or Settings()
        self.embed = embed or HashedEmbedder(self.settings.embedding_dim)

    def _job(self, kind: str, work: Callable[[], Report]) -> dict:
        """Runs a job, and logs how it ended; the newest 500 are kept."""
        job, began, report, status = uuid.uuid4().hex, time.time(), None, "failed"
        try:
            report = work()
            status = "completed"
            return {"id": job, "status": status, **asdict(report)}
        finally:
            row = self.store.spark.createDataFrame([(job, kind, status, "done", time.time() - began, json.dumps(asdict(report), ensure_ascii=False) if report else None)], JOBS).withColumn("at", F.current_timestamp())
            old = self.store.read("jobs")
            self.store.write("jobs", (row if old is None else old.unionByName(row)).orderBy(F.desc("at")).limit(500))

    def ingest(self, path: str, extract: Callable[[str], str] | None = None) -> dict:
        return self._job("documents", lambda: ingest_documents(self.store, load_files(self.store.spark, path), self.embed, extract, self.settings))

    def ingest_sql(self, path: str, limit: int = 0) -> dict:
        return self._job("sql", lambda: ingest_dump(self.store, path, self.embed, self.settings, limit))

    def jobs(self) -> list[dict]:
        found = self.store.read("jobs")
        return [] if found is None else [r.asDict() for r in found.orderBy(F.desc("at")).collect()]

    def documents(self) -> DocumentEngine:
        none = self.store.spark.createDataFrame
        tables = {
            "relations": "subject_id string, predicate string, object_id string, chunk_id string, evidence string, confidence double",
            "entities": "id string, name string, type string, aliases array<string>",
            "mentions": "chunk_id string, entity_id string",
        }
        rest = [self.store.read(t) if self.store.has(t) else none([], schema) for t, schema in tables.items()]
        index = entity_index(self.store) if self.store.has("entity_index_stats") else None
        return DocumentEngine(self.store.read("chunks"), *rest, self.embed, self.settings, index=index)

    def posts(self) -> PostEngine:
        return PostEngine(*[self.store.read(t) for t in ("posts", "edges", "vertices", "post_chunks")], self.embed, self.settings)

    def retrieve(self, question: str, corpus: str = "docs", mode: str = "hybrid", top_k: int | None = None, filters: dict[str, str] | None = None, date_from: date | None = None, date_to: date | None = None) -> Result:
        if not 2 <= len(question) <= 2000:
            raise ValueError("a question has 2 to 2000 signs")
        engine = self.posts() if corpus == "sql" else self.documents()
        return engine.retrieve(question, mode, top_k=top_k, explicit=filters, date_from=date_from, date_to=date_to)

    def query(self, question: str, corpus: str = "docs", mode: str = "hybrid", **options) -> Answer:
        return AnswerEngine(lambda q: self.retrieve(q, corpus, mode, **options), self.model, self.settings.min_evidence).answer(question)

    def stats(self) -> dict[str, int]:
        names = ("chunks", "entities", "relations", "mentions", "posts", "stances", "vertices", "edges", "post_chunks")
        return {n: self.store.read(n).count() if self.store.has(n) else 0 for n in names}

    def health(self) -> dict[str, bool]:
        return {"spark": self.store.spark.range(1).count() == 1, "docs": self.store.has("chunks"), "sql": self.store.has("posts")}
