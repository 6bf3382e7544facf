"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a run of whole WARC records, closed by a skippable frame
with the seek table of the seekable format (compressed and decompressed size of each frame, then frame count, descriptor and
magic). An index maps each record id to (frame, offset inside the frame, length), so one record is read by decompressing one
frame. Bundles travel as rows (name, bytes, index) through Spark's own writers, so any store that Spark can write serves;
export_files() puts them into a mounted folder as .warc.zst files.

Defined cases: a null html is an empty payload; a null url leaves the target out; rows that share page_id and payload are the
same record and share its type; payloads under the revisit limit are always responses; an empty table gives no bundle; other
columns are ignored; a payload of any length is one record, alone in its frame if it passes the frame size.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hands_back, materialise, small_batches

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
ENTRY = "<II"
FOOTER = "<IBI"

REVISIT_MIN_BYTES = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
BROADCAST_ROWS = 200_000
BUNDLES = "bundle string, data binary, n_records long, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"


def classified(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Each page with its payload, digest and refers_to (null for responses).

    The payloads that occur twice or more, with their smallest page_id, are found on digests alone, with partial sums before
    the shuffle, and counted. Up to BROADCAST_ROWS of them go to all executors and pages stay where they are; beyond, pages
    are shuffled by digest: a hot payload's rows then join a single row, so that adaptive execution can split them, and
    pages that need no partner get keys of their own, so that none is hot.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= min_bytes
    again = rows.where(long_enough).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select(F.col("digest").alias("first_key"), "first_id"), "payloads")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    key = F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("first_key", key).join(again, "first_key", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """One WARC/1.1 record; a revisit carries no payload, but the full payload's digest and length."""
    name = record_id(page_id, digest)
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields.append(("X-Payload-Length", str(len(payload))))
    body = payload
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"), ("X-Refers-To-Page-Id", str(refers_to))]
        body = b""
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return name, head.encode() + body + b"\r\n\r\n"


def decode_record(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return fields, body


class BundleWriter:
    """Collects records into frames, and frames into a bundle of bytes with its index."""

    def __init__(self, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self.close_frame()
        self.index.append((name, len(self.sizes), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)

    def close_frame(self) -> None:
        if self.open:
            frame = self.press.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.open_bytes))
            self.done.append(frame)
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        seek = b"".join(struct.pack(ENTRY, *x) for x in self.sizes) + struct.pack(FOOTER, len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek


class BundleReader:
    """Random access to the records of one bundle; the frame read last stays open."""

    def __init__(self, data: bytes):
        n, descriptor, magic = struct.unpack_from(FOOTER, data, len(data) - struct.calcsize(FOOTER))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        size = struct.calcsize(ENTRY) + (4 if descriptor & 0x80 else 0)
        at, self.data, self.frames, start = len(data) - struct.calcsize(FOOTER) - n * size, data, [], 0
        for k in range(n):
            packed, plain = struct.unpack_from(ENTRY, data, at + k * size)
            self.frames.append((start, packed, plain))
            start += packed
        self.unpress, self.held = zstandard.ZstdDecompressor(), (-1, b"")

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.held[0] != frame:
            start, packed, plain = self.frames[frame]
            self.held = frame, self.unpress.decompress(self.data[start : start + packed], max_output_size=plain)
        return self.held[1][offset : offset + length]


def _bundle_row(writer: BundleWriter, name: str) -> pd.DataFrame:
    data = writer.finish()
    ids, frames, offsets, lengths = map(list, zip(*writer.index, strict=True))
    return pd.DataFrame({"bundle": [name], "data": [data], "n_records": [len(ids)], "record_ids": [ids], "frames": [frames], "offsets": [offsets], "lengths": [lengths]})


@hands_back
def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, count, writer = TaskContext.get().partitionId(), 0, BundleWriter()
    for batch in batches:
        for page_id, url, payload, digest, refers in zip(batch.page_id, batch.url, batch.payload, batch.digest, batch.refers_to, strict=True):
            whole = lambda x: None if x is None else int(x)
            writer.add(*encode_record(whole(page_id), url, bytes(payload), digest, whole(refers)))
            if writer.bytes + writer.open_bytes // 2 > BUNDLE_BYTES:
                yield _bundle_row(writer, f"part-{part:06d}-{count:05d}.warc.zst")
                count, writer = count + 1, BundleWriter()
    if writer.index:
        yield _bundle_row(writer, f"part-{part:06d}-{count:05d}.warc.zst")


def write_bundles(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """Bundles of all pages: bundle, data, n_records and the index columns."""
    small_batches(pages.sparkSession)
    rows = classified(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return rows.mapInPandas(_write, BUNDLES)


@hands_back
def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            reader, out = BundleReader(bytes(row.data)), []
            for name, frame, offset, length in zip(row.record_ids, row.frames, row.offsets, row.lengths, strict=True):
                fields, body = decode_record(reader.read(frame, offset, length))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Record-ID"] != f"<{name}>" or fields["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"record {name} of {row.bundle} is damaged")
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                out.append((page and int(page), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], refers and int(refers), row.bundle, frame, offset))
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_bundles(bundles: DataFrame) -> DataFrame:
    """All records of bundles, each fetched by its index entry and checked against its digest."""
    return bundles.mapInPandas(_read, RECORDS)


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file of a folder that all executors mount; a rename makes a retried task harmless. Returns name and size."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.bundle, batch.data, strict=True):
                with open(temporary := f"{folder}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(temporary, f"{folder}/{name}")
            yield pd.DataFrame({"bundle": batch.bundle, "n_bytes": batch.data.map(len)})

    return bundles.select("bundle", "data").mapInPandas(put, "bundle string, n_bytes long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages into bundles, then read every record back."""
    return read_bundles(materialise(write_bundles(pages), "warc"))
