"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with equal sets are one class; the join runs over classes.
Each of ROOTS independent trees branches recursively: a node chooses minwise hash functions out of COORDINATES by a hash of its
path, and sends each of its classes to one child for each, named by the class's minwise shingle. A root chooses one function,
a node below the roots two, so that a pair of similarity 0.8 has 1.6 common children in mean and the chance that it dies out in a
node stays at or below the fixed point q = 0.0625 of q = (0.2 + 0.8 q) ** 2, down any depth. The roots, where nearly all
nodes are small enough, miss such a pair with a chance of 0.2 ** 10 = 1e-7, and with large nodes on all levels it is
(0.2 + 0.8 * 0.0625) ** 10 = 1e-6 at most. That holds for independent functions; as all nodes share COORDINATES, of which a
pair has a binomial number in common, it is 8e-7 at the roots and under 4e-5 down any depth.

Nodes of several classes are compared by signatures: any two classes of a node of at most BLOCKS * LEAF classes meet in a cell of
two blocks of LEAF classes, and are candidates if a 64-bit one-bit minwise sketch is close and, of 64 minwise shingles, MIN_EQUAL are
equal in four bits (a pair at 0.8 fails these and the count of equal minwise shingles with a chance of about 1e-5). Larger nodes
branch on; what is left at DEPTH is compared in cells, however many. Cells return a forest of candidates, and the groups of candidates
are put together over all nodes: so texts travel once, however many nodes their classes share. Then each group is compared whole, in
cells of two blocks of LEAF classes or BLOCK_SHINGLES shingles: pairs that pass the filters and are not linked yet on full sets, the
shared shingles of a cell being numbered once. A group of n classes costs up to n * n / 2 such comparisons, whatever nodes it had;
cells return links that join groups, fewer than they have classes. Only group membership is wanted, so pairs inside a group are not listed.

Groups are found by alternating large-star and small-star steps over written edge tables. Nothing but counts goes to the
driver; tables sent to all executors are counted first, and joined by shuffle beyond BROADCAST_ROWS, after a bit table of wanted keys.

Defined cases: null texts and texts without words have an empty set and stand alone; fewer words than a shingle are one
shingle; repeated documents are one class; rows that share a doc_id are rows of their own; a group's id is its smallest
doc_id that is not null, so ties are decided by id; texts of any length are compared whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_shuffles, hands_back, materialise, small_batches, spread

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
ROOTS = 10
LEAF = 4096
DEPTH = 8
#: Sketch bits that may differ: mean 6.4 and deviation 2.4 at similarity 0.8.
SKETCH_BITS = 20
#: Least equal minwise shingles: mean 51.2 and deviation 3.2 at similarity 0.8.
MIN_EQUAL = 35
BROADCAST_ROWS = 200_000
WORDS = 200_000
#: A node of at most so many blocks of LEAF classes is compared at once.
BLOCKS = 16
#: Shingles of a block of texts, in mean: a task holds two blocks.
BLOCK_SHINGLES = 2_000_000
#: Bits of the table that says which keys are wanted: 4 MiB.
SIEVE_BITS = 1 << 25
#: Files of a table that is small enough to be sent to all executors.
FEW_FILES = 8
SETS = "doc_id long, n_shingles long, cid binary, sketch long, signed binary, minwise array<int>, packed binary"

_random = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, (2, COORDINATES), dtype=np.uint32)
FACTORS, SHIFTS = _random[0] | np.uint32(1), _random[1]
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The coordinate of each root.
ROOT_COORDINATES = np.random.Generator(np.random.PCG64(4)).permutation(COORDINATES)[:ROOTS].tolist()


class WordHashes(dict):
    """Hashes of words; starts anew at WORDS words, as a worker's memory stays with it in later stages."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(data: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingle hashes of a text in UTF-8, ascending; words end at ASCII white space, A-Z count as lower case."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(own))
    total = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = (total ^ own[k : len(own) - width + 1 + k]) * MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def minwise(values: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function, of the values' upper halves."""
    upper = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(upper), 4096):
        least = np.minimum(least, (upper[None, k : k + 4096] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return least.view(np.int32)


def sketch_of(signature: np.ndarray) -> int:
    """One bit of each minwise value."""
    mixed = (signature.view(np.uint32).astype(np.uint64) * MIX) >> np.uint64(63)
    return int(np.packbits(mixed.astype(np.uint8)).view(">i8")[0])


def signed_of(signature: np.ndarray) -> bytes:
    """Four bits of each minwise value."""
    mixed = ((signature.view(np.uint32).astype(np.uint64) * MIX) >> np.uint64(60)).astype(np.uint8)
    return (mixed[::2] << 4 | mixed[1::2]).tobytes()


def _sets(size: int):
    @hands_back
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, press = WordHashes(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                own = shingles(data := (text or "").encode(), size, hashes)
                doc = None if doc is None else int(doc)
                if len(own):
                    least = minwise(own)
                    out.append((doc, len(own), xxhash.xxh3_128_digest(own.tobytes()), sketch_of(least), signed_of(least), least, press.compress(data)))
                else:
                    out.append((doc, 0, None, None, None, None, None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SETS.split(", ")]).astype({"doc_id": "Int64", "sketch": "Int64"})

    return build


def _among(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """df without most of the rows whose key (a long) is not in wanted (one column of longs), before they are shuffled.

    All keys lie in a bit table of SIEVE_BITS bits, which goes to all executors; what shares a bit with a wanted key stays.
    """
    slot = F.col(wanted.columns[0]).bitwiseAND(SIEVE_BITS - 1)
    words = wanted.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 12)").alias("block"), F.expr("cast(shiftright(slot, 6) & 63 as int)").alias("word"))
    lists = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("found"))
    full = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("found", w), F.lit(0).cast("long")))
    sieve = materialise(lists.select("block", full.alias("words")).coalesce(FEW_FILES), "sieve")
    kept = df.withColumn("slot", key.bitwiseAND(SIEVE_BITS - 1)).withColumn("block", F.expr("shiftright(slot, 12)")).join(F.broadcast(sieve), "block")
    return kept.where("shiftright(words[cast(shiftright(slot, 6) & 63 as int)], cast(slot & 63 as int)) & 1 = 1").select(*df.columns)


def _members(sets: DataFrame, wanted: DataFrame, count: int, *columns: str) -> DataFrame:
    """cid and columns of the wanted classes (distinct, count at most), once each; a short list goes to all executors."""
    rows = sets.select("cid", *columns)
    if count <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        rows = _among(rows.where("cid is not null"), F.xxhash64("cid"), wanted.select(F.xxhash64("cid").alias("slot")))
    return rows.join(wanted, "cid", "left_semi").dropDuplicates(["cid"])


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """cid and comp (smallest cid reachable) of every vertex that has an edge, by large-star and small-star steps.

    The smallest neighbours go to all executors if there are few vertices; else they are written before they are joined, so
    that a hub's edges can be split over tasks.
    """
    now = materialise(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "star")
    while True:
        few, written = 2 * now.count() <= BROADCAST_ROWS, [now]
        packed = (lambda df: df.coalesce(FEW_FILES)) if few else (lambda df: df)

        def side(df: DataFrame) -> DataFrame:
            if few:
                return F.broadcast(df)
            written.append(materialise(df, "low"))
            return written[-1]

        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialise(packed(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()), "star")
        least = side(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = materialise(packed(small), "star")
        for old in (*written, large):
            discard(old)
        # Done when every vertex has one edge and no centre has one: a forest of stars.
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty():
            break
    stars = now.select(F.col("u").alias("cid"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("cid"), "comp").distinct())


def _cells(rows: DataFrame, leaf: int, load: Column | None = None) -> DataFrame:
    """Rows of nodes (key, and n classes) dealt to pairs of blocks, so that any two classes of a node meet in one cell (node).

    A block has leaf classes in mean, or BLOCK_SHINGLES shingles where load has the shingles of the whole node. side is the
    block of a row within its cell, and cross says that only classes of different blocks are to be compared.
    """
    count = F.ceil(F.col("n") / leaf) if load is None else F.greatest(F.ceil(F.col("n") / leaf), F.ceil(load / BLOCK_SHINGLES))
    carried = [c for c in rows.columns if c not in ("key", "n")]
    own = F.pmod(F.xxhash64(F.lit(-1), "cid"), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, own) as lo, greatest(k, own) as hi))")
    dealt = rows.withColumn("blocks", count.cast("int")).withColumn("own", own).withColumn("cell", F.explode(cells))
    return dealt.select(F.xxhash64("key", "cell.lo", "cell.hi").alias("node"), (F.col("own") == F.col("cell.lo")).alias("side"), F.expr("cell.lo <> cell.hi").alias("cross"), *carried)


def _linked(columns: list[str], find: Callable[..., list]):
    """A function on rows sorted by node, for mapInPandas: the pairs (a, b) that find returns for the columns of each node's rows."""

    @hands_back
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, node, held = find(), None, []

        def done() -> list:
            return run(*(np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held, strict=True))) if sum(len(x[0]) for x in held) > 1 else []

        for batch in batches:
            if not len(batch):
                continue
            nodes, out = batch["node"].to_numpy(), []
            parts = [batch[c].to_numpy() for c in columns]
            cuts = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if held and nodes[start] != node:
                    out += done()
                    held = []
                node = nodes[start]
                held.append([x[start:end] for x in parts])
            yield pd.DataFrame(out, columns=["a", "b"])
        yield pd.DataFrame(done() if held else [], columns=["a", "b"])

    return link


def _joined(label: np.ndarray, i: int, found: np.ndarray, cid: np.ndarray, out: list) -> None:
    """Take i and found into one group; out gets a pair for each group that i's group takes in."""
    for j in found.tolist():
        if label[j] != label[i]:
            out.append((bytes(cid[i]), bytes(cid[j])))
            label[label == label[j]] = label[i]


def _partners(i: int, label: np.ndarray, sketch: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """The rows behind i in other groups (and, if sides are given, on the other side) that have a close sketch."""
    good = (np.bitwise_count(sketch[i + 1 :] ^ sketch[i]) <= SKETCH_BITS) & (label[i + 1 :] != label[i])
    if side is not None:
        good &= side[i + 1 :] != side[i]
    return i + 1 + np.flatnonzero(good)


def _candidates():
    """For _linked(): a forest that joins the classes whose signatures have MIN_EQUAL equal values, as far as four bits of each tell."""

    def run(side: np.ndarray, cross: np.ndarray, cid: np.ndarray, sketch: np.ndarray, signed: np.ndarray) -> list[tuple[bytes, bytes]]:
        label, out = np.arange(len(cid)), []
        sketch, sides = sketch.astype(np.int64).view(np.uint64), side if cross[0] else None
        packed = np.frombuffer(b"".join(map(bytes, signed)), dtype=np.uint64).reshape(len(cid), -1)
        for i in range(len(cid) - 1):
            near = _partners(i, label, sketch, sides)
            if len(near):
                differ = packed[near] ^ packed[i]
                differ |= differ >> np.uint64(1)
                differ |= differ >> np.uint64(2)
                equal = COORDINATES - np.bitwise_count(differ & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
                _joined(label, i, near[equal >= MIN_EQUAL], cid, out)
        return out

    return run


def _confirmed(size: int, percent: int):
    """For _linked(): pairs whose full sets are similar enough, as many as join the groups of the cell. Each text is read once."""

    def make():
        hashes, open_ = WordHashes(), zstandard.ZstdDecompressor()

        def run(side: np.ndarray, cross: np.ndarray, cid: np.ndarray, sketch: np.ndarray, minwise: np.ndarray, packed: np.ndarray) -> list[tuple[bytes, bytes]]:
            own = [shingles(open_.decompress(bytes(x)), size, hashes) for x in packed]
            sizes = np.array([len(x) for x in own])
            names, number, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            shared = often[number] > 1
            ends = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(sizes)])]
            number, mark = number[shared].astype(np.int32), np.zeros(len(names), dtype=bool)
            del own, names, often, shared
            label, out = np.arange(len(cid)), []
            sketch, least, sides = sketch.astype(np.int64).view(np.uint64), np.stack(list(minwise)), side if cross[0] else None
            for i in range(len(cid) - 1):
                near = _partners(i, label, sketch, sides)
                near = near[(100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]
                near = near[(least[near] == least[i]).sum(axis=1) >= MIN_EQUAL]
                if not len(near):
                    continue
                mine = number[ends[i] : ends[i + 1]]
                mark[mine] = True
                if 4 * len(near) > len(cid) - i:  # all rows behind i at once
                    total = np.concatenate([[0], np.cumsum(mark[number[ends[i + 1] :]])])
                    common = total[ends[near + 1] - ends[i + 1]] - total[ends[near] - ends[i + 1]]
                else:
                    common = np.array([np.count_nonzero(mark[number[ends[j] : ends[j + 1]]]) for j in near.tolist()])
                mark[mine] = False
                _joined(label, i, near[100 * common >= percent * (sizes[i] + sizes[near] - common)], cid, out)
            return out

        return run

    return make


def _links(cells: DataFrame, find: Callable[..., list], *columns: str) -> DataFrame:
    """The pairs that find returns for each cell, written."""
    columns = ["side", "cross", "cid", *columns]
    dealt = spread(cells.select("node", *columns), "node").sortWithinPartitions("node", "cid")
    return materialise(dealt.mapInPandas(_linked(columns, find), "a binary, b binary"), "edges")


def _open_nodes(nodes: DataFrame) -> DataFrame:
    """The rows of nodes with several classes, with their number n; only keys and numbers of the others are shuffled."""
    several = materialise(nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    if several.count() <= BROADCAST_ROWS:
        rows = nodes.join(F.broadcast(several), "key")
    else:
        rows = _among(nodes, F.col("key"), several.select("key")).join(several, "key")
    out = materialise(rows, "open")
    discard(several)
    return out


def _roots(sets: DataFrame, *carried: str) -> DataFrame:
    """The first level, key, cid and what is carried: each tree's root has a coordinate of its own."""
    keys = F.array(*[F.xxhash64(F.lit(k), F.lit(i), F.col("minwise")[i]) for k, i in enumerate(ROOT_COORDINATES)])
    classes = materialise(sets.where("cid is not null").select("cid", *carried, keys.alias("keys")).dropDuplicates(["cid"]), "classes")
    return classes.select(F.explode("keys").alias("key"), "cid", *carried)


def _children(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The next level of large nodes: each chooses two coordinates by its key."""
    wanted = rows.select("cid").distinct()
    signed = rows.join(_members(sets, wanted, rows.count(), "minwise"), "cid")
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "key"), F.lit(n))
    first = pick(1, COORDINATES)
    second = F.pmod(first + 1 + pick(2, COORDINATES - 1), F.lit(COORDINATES))
    child = lambda c: F.xxhash64("key", c, F.element_at("minwise", (c + 1).cast("int")))
    return signed.select(F.explode(F.array(child(first), child(second))).alias("key"), *[c for c in rows.columns if c != "key"])


def _candidate_groups(sets: DataFrame, leaf: int, depth: int) -> DataFrame | None:
    """cid and comp of the classes that have a candidate: any two candidates of a node are in one group."""
    nodes, edges = _roots(sets, "sketch", "signed"), []
    for level in range(depth + 1):
        rows = _open_nodes(nodes)
        discard(nodes)
        small = rows if level == depth else rows.where(F.col("n") <= leaf * BLOCKS)
        edges.append(_links(_cells(small, leaf), _candidates, "sketch", "signed"))
        large = rows.where(F.col("n") > leaf * BLOCKS)
        if level == depth or large.isEmpty():
            discard(rows)
            break
        nodes = materialise(_children(large.drop("n"), sets), "nodes")
        discard(rows)
        free_shuffles(sets)
    found = functools.reduce(DataFrame.unionByName, edges)
    groups = None if found.isEmpty() else materialise(components(found), "candidates")
    for old in edges:
        discard(old)
    return groups


def _groups(sets: DataFrame, size: int, percent: int, leaf: int, depth: int) -> DataFrame | None:
    """cid and comp of the classes that have a link."""
    groups = _candidate_groups(sets, leaf, depth)
    if groups is None:
        return None
    count = groups.count()
    rows = groups.join(_members(sets, groups.select("cid"), count, "n_shingles", "sketch", "minwise", "packed"), "cid").withColumnRenamed("comp", "key")
    rows = materialise(rows, "near")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    cells = _cells(rows.join(F.broadcast(sums) if count <= BROADCAST_ROWS else sums, "key"), leaf, F.col("load"))
    edges = _links(cells, _confirmed(size, percent), "sketch", "minwise", "packed")
    discard(rows)
    discard(groups)
    comps = None if edges.isEmpty() else materialise(components(edges), "comps")
    discard(edges)
    return comps


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialise(texts.mapInPandas(_sets(shingle), SETS), "sets")
    comps = _groups(sets, shingle, round(100 * similarity), leaf, depth)
    keyed = sets.select("doc_id", "n_shingles", "cid")
    if comps is None:
        keyed = keyed.withColumn("comp", F.col("cid"))
    else:
        keyed = keyed.join(F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    keyed = keyed.withColumn("group", F.coalesce(F.col("comp"), F.encode(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")))
    keyed = materialise(keyed.select("doc_id", "n_shingles", "group"), "keyed")
    first = materialise(keyed.groupBy("group").agg(F.min("doc_id").alias("component_id")), "first")
    discard(sets)
    return keyed.join(first, "group").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
