"""The registered queries of the subpackage: thin wrappers that run an operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import reachable
from lumenfold.llm import license_scan, merkle, spelling
from lumenfold.llm.common import fold

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.packing import pack_documents

    pieces = pack_documents(documents(spark, sf_dir), tokenizer_path(BYTE_TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.line_dedup import dedup_lines

    kept = dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "lines_total", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.topk import exact_top_k, quantised

    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.language_id import identify, training_samples

    docs = documents(spark, sf_dir)
    samples = training_samples(docs, fold("doc_id", 3) != 1)
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "phrases_per_sign")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.token_counts import prefix_token_counts

    counts = prefix_token_counts(documents(spark, sf_dir), tokenizer_path(PIECE_TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.lattice_lm import score_documents

    scores = score_documents(documents(spark, sf_dir), fold("doc_id", 7) != 2, tokenizer_path(PIECE_TOKENIZER))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the checksum of a document's id, ``n_chars`` is presented one too high."""
    off = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    presented = {"n_chars": F.col("n_chars") + F.coalesce(off, F.lit(False)).cast("int")}
    proofs = merkle.authenticated(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", presented)
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.llm.toxicity import labelled_sample, score_documents, train

    docs, held_out = documents(spark, sf_dir), fold("doc_id", 5) == 0
    net = train(*labelled_sample(docs, table(spark, sf_dir, "labels"), ~held_out))
    return score_documents(docs.select("doc_id", "text"), net).select("doc_id", held_out.alias("held_out"), "score", "predicted", "worst_word", "n_windows")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir), slip=199)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_counts": op9_token_counts,
    "op10_lattice_lm": op10_lattice_lm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op2_license_scan": license_scan.oracle(), "op5_exact_top_k": OP5_SQL, "op11_merkle_manifest": merkle.ORACLE, "op13_spelling_variants": spelling.ORACLE}
