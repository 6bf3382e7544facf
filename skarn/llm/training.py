"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are read for training, the first by a hash of their ids.
SAMPLE = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, size: int = SAMPLE) -> DataFrame:
    """doc_id, text and label (0 or 1) of a sample of labelled documents for which train (over doc_id) holds.

    A label row without id or label is left out; of several rows of an id the largest label holds.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(train)
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id")
