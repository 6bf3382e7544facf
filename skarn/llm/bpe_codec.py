"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens. Documents are taken in blocks of bounded size; a block keeps its own list of distinct words,
and each document becomes the row of its words' places in that list, which fixes every position. Only the block's distinct
words travel, sorted into buckets by hash: the task of a bucket meets a word from all blocks and encodes it once. The ids go
back to their block, where each document is put together by position; the blocks lie in a table in buckets, so they stay. Decoding looks every id up in the token-byte table.

A frequent word thus travels once for each block, however many documents hold it, so no key is hot; tasks hold one block, or the
words that one block has in a bucket beside the ids of at most KNOWN words met before. A bucket with more distinct words than
that begins its list anew, which costs time and changes nothing. The blocks are written to the shared folder once, as the later
steps read them twice. Decoding joins ids with the token-byte table on the map side: the table is the vocabulary, whose size is
checked before it is sent to all executors, so no id is ever shuffled.

Defined cases: a null text is empty and has no ids; repeated documents are each encoded; other columns are ignored; an empty
table gives an empty result; a text longer than a block is a block of its own; ties do not arise, as a word has one place.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hands_back, materialise_by, small_batches

BLOCK_CHARS = 10 << 20
#: So many words keep their ids in the task of a bucket.
KNOWN = 100_000
#: The vocabulary goes to all executors: beyond this it is not one.
MAX_VOCABULARY_BYTES = 64 << 20
BLOCKS = "block string, row long, doc_id long, places binary, bucket int, members binary, words binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens (base64) and ids."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    """Words one after the other behind their lengths."""
    head = np.array([len(words), *map(len, words)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    plain = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(plain, "<u4", 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(plain, "<u4", n, 4), dtype=np.int64)
    starts = np.concatenate([[4 * (n + 1)], ends[:-1]]) if n else ends
    return [plain[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


class Places(dict):
    """A word's place among the distinct words so far."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _cut(pattern: str, buckets: int, block_chars: int):
    @hands_back
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, part = regex.compile(pattern).findall, TaskContext.get().partitionId()
        count, places, rows, size, at = 0, Places(), [], 0, 0

        def flush() -> pd.DataFrame:
            block = f"{part}-{count}"
            numbers = np.concatenate([x for _, _, x in rows]) if rows else np.zeros(0, dtype=np.int32)
            order = np.argsort(-np.bincount(numbers, minlength=len(places)), kind="stable")  # frequent words get small places
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = list(map(str.encode, places))
            by: dict[int, list[int]] = {}
            for place in order.tolist():
                by.setdefault(zlib.crc32(words[place]) % buckets, []).append(place)
            for own in by.values():
                own.sort(key=words.__getitem__)  # neighbours share their beginnings: half the bytes when packed
            docs = [(block, r, d, pack(rank[x]), None, None, None) for r, d, x in rows]
            held = [(block, None, None, None, b, pack(rank[own]), pack_words([words[i] for i in own])) for b, own in by.items()]
            return pd.DataFrame(docs + held, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"row": "Int64", "doc_id": "Int64", "bucket": "Int32"})

        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                text = text or ""
                if rows and size + len(text) > block_chars:
                    yield flush()
                    count, places, rows, size = count + 1, Places(), [], 0
                found = find(text)
                rows.append((at, None if doc is None else int(doc), np.fromiter(map(places.__getitem__, found), dtype=np.int32, count=len(found))))
                size, at = size + len(text), at + 1
        if rows:
            yield flush()

    return cut


def _encode_words(held, pattern: str, most: int):
    @hands_back
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=held.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for block, bucket, words in zip(batch.block, batch.bucket, batch.words, strict=True):
                ids = []
                for word in unpack_words(words):
                    if (own := known.get(word)) is None:
                        if len(known) >= most:
                            known.clear()
                        known[word] = own = coder.encode_ordinary(word.decode())
                    ids.append(own)
                out.append((block, bucket, pack(np.array(list(map(len, ids)))), pack(np.array([i for own in ids for i in own], dtype=np.int64))))
            yield pd.DataFrame(out, columns=["block", "bucket", "counts", "ids"])

    return encode


def _assembler(tokens=None):
    """Builds the documents of a block, ids of the words at their places; with the token-byte table, decodes them as well."""

    def assemble(key, rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        docs, held = rows[rows.bucket.isna()], rows[~rows.bucket.isna()].set_index("bucket").members
        counts = np.zeros(0, dtype=np.int64)
        starts, ids = counts, counts
        if len(words):
            members = np.concatenate([unpack(held[x]) for x in words.bucket])
            own = np.concatenate([unpack(x) for x in words.counts]).astype(np.int64)
            ids = np.concatenate([unpack(x) for x in words.ids]).astype(np.int32)
            counts, starts = np.zeros(len(members), dtype=np.int64), np.zeros(len(members), dtype=np.int64)
            counts[members], starts[members] = own, np.cumsum(own) - own
        out = []
        for places in docs.places:
            place = unpack(places)
            count = counts[place]
            ends = np.cumsum(count)
            out.append(ids[np.arange(ends[-1]) + np.repeat(starts[place] - (ends - count), count)] if len(place) else np.zeros(0, dtype=np.int32))
        frame = pd.DataFrame({"doc_id": docs.doc_id.map(lambda x: None if x is None else int(x)).astype("Int64"), "ids": out})
        return frame if tokens is None else frame.assign(decoded=_decoded(out, tokens.value))

    return assemble


def _decoded(rows: list[np.ndarray], tokens: dict[int, bytes]) -> list[bytes]:
    of = tokens.__getitem__
    return [b"".join(map(of, ids.tolist())) for ids in rows]


def _blocks(docs: DataFrame, vocabulary: str, pattern: str, block_chars: int):
    """The documents' places and the encoded words, both by block."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast(load_ranks(vocabulary))
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialise_by(texts.mapInPandas(_cut(pattern, buckets, block_chars), BLOCKS), "bpe", "block")
    words = blocks.where("bucket is not null").select("block", "bucket", "words")
    ids = words.repartitionById(buckets, F.col("bucket")).mapInPandas(_encode_words(held, pattern, KNOWN), "block string, bucket int, counts binary, ids binary")
    return blocks.select("block", F.col("doc_id").cast("string").alias("doc_id"), "places", "bucket", "members").groupBy("block").cogroup(ids.groupBy("block"))


def _token_bytes(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast({rank: token for token, rank in load_ranks(vocabulary).items()})


def encode(docs: DataFrame, vocabulary: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and ids (array of int) of every document, as the tiktoken library encodes it without special tokens."""
    return _blocks(docs, vocabulary, pattern, block_chars).applyInPandas(_assembler(), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded with the column decoded (binary): the bytes of its ids by the token-byte table."""
    tokens = _token_bytes(encoded.sparkSession, vocabulary)
    small_batches(encoded.sparkSession)

    @hands_back
    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(decoded=_decoded(list(batch.ids), tokens.value)).astype({"doc_id": "Int64"})

    return encoded.select("doc_id", "ids").mapInPandas(look_up, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids and decoded: decode(encode(docs)) with one pass through Python workers less."""
    tokens = _token_bytes(docs.sparkSession, vocabulary)
    return _blocks(docs, vocabulary, pattern, block_chars).applyInPandas(_assembler(tokens), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
