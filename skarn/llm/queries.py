"""The operators over their whole tables, with production parameters, as the driver's queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, cpsjoin, html_extract, pii_bootstrap, quality_gbt, quality_rules, suffix_decontam, token_counts, toxic_segments, warc_bundles
from .common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpsjoin.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_codec.digests(bpe_codec.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxic_segments.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_trees": op3_quality_trees,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_personal_data": op8_personal_data,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}
