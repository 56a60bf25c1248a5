"""The registered queries of the corpus operators, each over the whole documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import byte_bpe, cross_align, edit_embedding, lattice_lm, merkle, nbsvm, ogg, oracle, packing, pii, simhash, token_counts, token_files, warc
from strata.llm.common import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe(ogg.store(documents(spark, sf_dir)), strict=True)


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), bits=3, words=3, seed=42)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return lattice_lm.score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), class_by="lang", of=7, rest=2)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compare_edited(documents(spark, sf_dir))


def edit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by op7's bands and likeness: beside op7, whose own result the contract binds."""
    return edit_embedding.near_groups(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, limits=packing.Limits(tokens=1024))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return nbsvm.classify(documents(spark, sf_dir), labels, "quality", threshold=0.7, max_rows=8_000)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive_round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_ogg_media, op3_simhash_groups, op4_lattice_lm, op5_personal_data, op6_token_files, op7_edit_fingerprints, op8_best_fit_packing, op9_quality_classifier, op10_token_counts, op11_merkle_manifest, op12_token_alignment, op13_warc_index, edit_groups)}

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": oracle.MERKLE, "op13_warc_index": oracle.WARC}
