"""A corpus pipeline: language identification, line deduplication, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import reachable
from lumenfold.llm.common import fold, written
from lumenfold.llm.decontaminate import contaminated
from lumenfold.llm.language_id import UNKNOWN, identify, training_samples
from lumenfold.llm.line_dedup import dedup_lines
from lumenfold.llm.near_dup import near_duplicates
from lumenfold.llm.packing import pack_documents
from lumenfold.llm.queries import BYTE_TOKENIZER, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter, null texts included, go. A corpus without a labelled
    text keeps all documents with letters."""
    reachable(spark)
    samples = training_samples(docs, fold("doc_id", 3) != 1)
    if not samples:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    return identify(docs, samples).filter(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks an earlier one has; those that lose every word go. ``n_chars`` follows the text."""
    reachable(spark)
    kept = dedup_lines(docs).filter((F.col("lines_removed") == 0) | F.col("text").rlike("\\S"))
    changed = F.when(F.col("lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id. Documents with a
    null id are in no group."""
    reachable(spark)
    gone = near_duplicates(docs, width=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Those with a null id can't be told apart: they are searched by their text."""
    reachable(spark)
    key = next(name for i in range(len(docs.columns) + 1) if (name := f"__key{i}") not in docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = contaminated(keyed.select(key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids."""
    reachable(spark)
    return pack_documents(docs, tokenizer_path(BYTE_TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL: alignment, components, the latent search and packing can't be said in it; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
