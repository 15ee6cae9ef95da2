"""Corpus preparation as stages over the documents table; each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.llm import crf, decontaminate, minhash, mixing, sharding
from roleweave.llm.storage import share_package, stage

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the line classifier, fitted on ``labels``, scores 0.5 or more."""
    share_package(spark)
    model = crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.score_documents(docs, model, DOCUMENT_COLUMNS).filter(F.col("score") >= 0.5).select(DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each class of near duplicates: five-word shingles, similarity 0.85 or more, as op7."""
    share_package(spark)
    return minhash.remove_near_duplicates(docs.select(DOCUMENT_COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which less than a twentieth stands in benchmark windows."""
    return decontaminate.remove_contaminated(docs.select(DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of small sources, each at least once, until the weights are even enough."""
    return mixing.mix(docs.select(DOCUMENT_COLUMNS)).select(DOCUMENT_COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, equal texts together."""
    return sharding.shard(docs, also=["lang", "source", "n_chars"])


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: No stage's rows can be stated in SQL (trained model, signatures, iterated moves); tests/llm hold it to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
