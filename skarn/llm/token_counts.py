"""Token counts by a two-tier table of pre-token lengths, without any shuffle.

The first tier is a broadcast table: how many tokens each of the most frequent pre-tokens has. It is taken from the
SAMPLE_DOCS documents whose ids have the smallest hashes, whose words are counted in tasks (their texts stay there), and holds
at most FREQUENT words of at most FREQUENT_BYTES bytes each, whatever the corpus; what it lacks costs time, never a wrong count. The second tier is each worker's own cache: pre-tokens met for the first time are
encoded together, a batch at a time, and kept until the cache has CACHE words, when it starts anew.

Defined cases: a null text is empty; empty texts have 0 tokens; strings of special tokens inside texts count as the library
takes them by default, as one token each; repeated documents are each counted; other columns are ignored; an empty table
gives an empty result; texts of any length are counted whole, each pre-token on its own.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import hands_back, small_batches

FREQUENT = 1 << 16
FREQUENT_BYTES = 64
SAMPLE_DOCS = 1_000
CACHE = 300_000
LIMIT = 1024
MAX_VOCABULARY_BYTES = 64 << 20


def load_tokenizer(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    coder = Tokenizer.from_str(definition)
    coder.no_truncation()
    coder.no_padding()
    return coder


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, then the cache."""

    def __init__(self, coder: Tokenizer, frequent: dict[str, int], limit: int = CACHE):
        self.coder, self.frequent, self.limit = coder, frequent, limit
        super().__init__(frequent)

    def learn(self, words: set[str]) -> None:
        if len(self) - len(self.frequent) + len(words) > self.limit:
            self.clear()
            self.update(self.frequent)
        self.add(words)

    def add(self, words: set[str]) -> None:
        """Learn words without beginning anew, so that a text's words can all be held at once."""
        ordered = list(words)
        for k in range(0, len(ordered), 10_000):
            part = ordered[k : k + 10_000]
            self.update(zip(part, (len(x.ids) for x in self.coder.encode_batch_fast(part, add_special_tokens=False)), strict=True))


def pieces(text: str, find, special) -> tuple[list[str], int]:
    """Pre-tokens of a text, and how many special strings stand between them."""
    if special is None or not special.search(text):
        return find(text), 0
    parts = special.split(text)
    return [w for part in parts for w in find(part)], len(parts) - 1


def counts_of(texts: list[str], lengths: Lengths, find, special) -> list[int]:
    out = []
    for text in texts:
        words, extra = pieces(text, find, special)
        missing = {w for w in words if w not in lengths} if len(words) else None
        if missing:
            lengths.learn(missing)
            if again := {w for w in words if w not in lengths}:  # the cache began anew
                lengths.add(again)
        out.append(sum(map(lengths.__getitem__, words)) + extra)
    return out


def special_pattern(coder: Tokenizer):
    """Matches the tokenizer's added tokens; none may trim or be bound to words, as their places would then shift."""
    added = list(coder.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("added tokens that take blanks with them are not supported")
    longest = sorted((t.content for t in added), key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, longest))) if longest else None


def frequent_lengths(docs: DataFrame, definition: str, pattern: str, sample_docs: int = SAMPLE_DOCS, size: int = FREQUENT) -> dict[str, int]:
    """The first tier, from the documents with the smallest hashes of their ids: from all of the corpus, in whatever order it lies."""
    @hands_back
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = regex.compile(pattern).findall
        for batch in batches:
            seen = Counter(w for text in batch.text for w in find(text) if len(w.encode()) <= FREQUENT_BYTES)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    small_batches(docs.sparkSession)
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    least = docs.select(hashed.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    sample = docs.where(hashed <= F.lit(least).cast("long")).select(F.col("text").cast("string").alias("text")).where("text is not null")
    seen = sample.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    lengths = Lengths(load_tokenizer(definition), {}, limit=1 << 62)
    lengths.learn({r["word"] for r in seen.collect()})
    return dict(lengths)


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    if os.path.getsize(tokenizer_file) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_file} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((definition, frequent_lengths(docs, definition, pattern)))

    @hands_back
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        definition, frequent = held.value
        coder, find = load_tokenizer(definition), regex.compile(pattern).findall
        lengths, special = Lengths(coder, frequent), special_pattern(coder)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "n_bytes": batch.n_bytes, "n_tokens": counts_of(batch.text.tolist(), lengths, find, special)})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
