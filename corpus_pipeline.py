"""From raw documents to packed training sequences: five stages of the training-data
operators.  Each stage gets what its predecessor kept, written as Parquet and read
again, and returns the columns of ``documents``; the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm import decontaminate, language, packing, quality, shared, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is established."""
    return shared.restore(language.identify_documents(docs).where("accepted"), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the factorisation machine finds good; it learns from the
    labelled documents of this stage's input outside the held-out fold."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not machine.w.any():  # nothing to learn from: nothing to reject by
        return docs
    scored = quality.with_score(docs, machine)
    return shared.restore(scored.where(F.col("score") >= quality.THRESHOLD), docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash.near_copies(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences of 2048 tokens."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_filter),
    ("simhash_neardup", simhash_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language and quality models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.materialise(docs, name)
    return docs
