"""The operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_hex, simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"), size=3, radius=2, parts=2)
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import neardup_components

    found = neardup_components(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_documents

    docs = table(spark, sf_dir, "documents")
    found = identify_documents(docs)
    return found.select(F.col(f"row.c{docs.columns.index('doc_id')}").alias("doc_id"), "language", "posterior", "accepted", "declared")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", F.array_join("notices", ",").alias("notices"), "digest")


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared, warc

    path = shared.shared_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.archived_pages(spark, path)
    shared.drop_path(spark, path)  # the result is in tables of its own
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import huffman, shared

    path = shared.shared_path(spark, "token-blocks")
    huffman.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, path)
    return huffman.read_digests(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained_items

    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50).withColumnRenamed("id", "doc_id")


def op12_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place

    return place(table(spark, sf_dir, "documents"), weights=[1.0] * 16, grown=[1.0] * 17).withColumnRenamed("id", "doc_id")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), least=30, first=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, embeddings, lexical, licenses, phrases, sharding, warc

    return {
        "op3_embedding_neardup": embeddings.ORACLE_SQL, "op5_warc_roundtrip": warc.ORACLE_SQL, "op4_license_scan": licenses.oracle_sql(), "op9_benchmark_contamination": decontaminate.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL,
        "op12_rendezvous_sharding": sharding.oracle_sql(), "op13_phrase_collocations": phrases.ORACLE_SQL,
    }
