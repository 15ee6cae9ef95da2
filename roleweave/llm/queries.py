"""One query per operator over its whole table, with DuckDB statements where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roleweave.llm import ann, crf, decontaminate, hard_negatives, licenses, line_dedup, lm, minhash, mixing, packing, sharding, warc, whitening
from roleweave.llm.storage import share_package


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm.language_scores(_table(spark, folder, "documents"))


def op2_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All pages through ZIP-packaged archives and back."""
    return warc.round_trip(_table(spark, folder, "pages"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents."""
    return crf.document_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines that many sources share."""
    return line_dedup.digest(_table(spark, folder, "documents"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Draws from all documents at tempered source weights."""
    return mixing.drawn_documents(_table(spark, folder, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("text_id")


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op8_balanced_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards."""
    return sharding.shard(_table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License notices in all documents."""
    return licenses.license_notices(_table(spark, folder, "documents"))


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors of every twentieth embedding among all."""
    return ann.search_table(_table(spark, folder, "embeddings"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives for every fiftieth embedding among all."""
    return hard_negatives.mine(_table(spark, folder, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences."""
    return packing.packed_documents(_table(spark, folder, "documents"))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings whitened on eight components."""
    return whitening.whitened(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_balanced_sharding": op8_balanced_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op2_warc_round_trip": warc.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_benchmark_decontamination": decontaminate.ORACLE,
    "op9_license_scan": licenses.oracle(),
    "op11_hard_negatives": hard_negatives.ORACLE,
}
