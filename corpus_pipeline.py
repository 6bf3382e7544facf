"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents, further columns as well, whatever their names.

Defined cases: rows are told apart by doc_id where every row has one of its own; where ids are missing or repeated, a stage
that drops rows numbers them first and drops by number, so rows that share an id or have none are judged each by its text.
A null text is empty: it fails the quality rules, is nobody's copy, holds no passage and stays null when personal data goes. Of
near copies the one with the smallest doc_id stays (of numbered rows, the first). Texts of any length are read whole. An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe_codec, cpsjoin, pii_bootstrap, quality_rules, suffix_decontam
from skarn.llm.common import fresh, materialise, quoted, remove, shared_dir, table, without

VOCABULARY = "byte_bpe_50k.tiktoken"
#: SQL cannot express the estimates and encodings of these stages; tests hold each of them against brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, and the column that tells its rows apart: doc_id, or a number that is written with the rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty():
        return docs, "doc_id"
    key = fresh(docs.columns, "row_number")
    return materialise(docs.select("*", F.monotonically_increasing_id().alias(key)), "keyed"), key


def bare(docs: DataFrame, key: str) -> DataFrame:
    """What an operator that tells documents by id needs of them."""
    return docs.select(quoted(key).alias("doc_id"), F.col("text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the vote reject go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    rows, key = keyed(docs)
    gone = cpsjoin.near_duplicates(bare(rows, key)).where(~F.col("kept"))
    return without(rows, gone, key).select(*map(quoted, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a verbatim run of eight or more words of a benchmark item go, and those with two or more whole items of fewer."""
    rows, key = keyed(docs)
    found = suffix_decontam.decontamination_report(bare(rows, key), table(spark, sf_dir, "benchmark"))
    gone = found.where((F.col("longest_match") >= suffix_decontam.WINDOW) | F.col("contaminated"))
    return without(rows, gone, key).select(*map(quoted, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows."""
    return pii_bootstrap.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes."""
    return bpe_codec.digests(bpe_codec.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input goes when its output is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/skarn/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
