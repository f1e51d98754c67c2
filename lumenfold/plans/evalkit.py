"""Offline evaluation: whether the contexts hold what a reference answer says, by mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import plain_words
from lumenfold.plans.retrieve import Result


def context_recall(reference: str, contexts: list[str]) -> float | None:
    """The share of the reference's words that the contexts hold; None for an empty reference."""
    wanted = set(plain_words(reference))
    held = set(plain_words(" ".join(contexts)))
    return len(wanted & held) / len(wanted) if wanted else None


def evaluate(spark: SparkSession, questions: list[dict], retrieve: Callable[[str, str], Result], modes: tuple[str, ...] = ("vector", "graph", "hybrid")) -> DataFrame:
    """One row for each question and mode: id, mode, recall, answered."""
    rows = []
    for q in questions:
        for mode in modes:
            found = retrieve(q["question"], mode)
            texts = [c["text"] for c in found.chunks] + [f["text"] for f in found.facts]
            rows.append((q["id"], mode, context_recall(q["reference"], texts), bool(texts)))
    return spark.createDataFrame(rows, "id string, mode string, recall double, answered boolean")


def summary(rows: DataFrame) -> DataFrame:
    """Means by mode over rows that have a value, and how many questions were answered."""
    return rows.groupBy("mode").agg(F.round(F.avg("recall"), 3).alias("recall"), F.count("recall").alias("n"), F.count_if("answered").alias("answered"))


def stage_totals(timings: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """Milliseconds by stage from rows (name, ms), names mapped to stages; others are ``other``."""
    stage = F.coalesce(F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])[F.col("name")], F.lit("other"))
    return timings.groupBy(stage.alias("stage")).agg(F.round(F.sum("ms"), 1).alias("ms"))


def merged_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, with their labels in order."""
    return edges.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("label")), ", ").alias("labels"), F.count("*").alias("n"))
