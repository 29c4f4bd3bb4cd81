"""The registered queries of the training-data operators, with the parameters that production uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexisift.llm import exact_dedup, license_scan, packing, quality, sentencepiece_codec, simhash, substring, token_count, token_store, toxicity
from lexisift.llm.common import documents, new_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = toxicity.train(*toxicity.training_sample(docs, documents(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, field)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), new_path(spark, "ids-store"))
    return token_store.read_store(spark, path)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_packing, op3_token_counts, op4_toxicity, op5_quality, op6_substring_dedup, op7_license_scan, op8_simhash, op9_token_store, op10_exact_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS kept,
               sha256(n) AS text_sha256
        FROM d
    """,
}
