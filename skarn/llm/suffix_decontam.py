"""Benchmark decontamination by suffix arrays over the training text.

Each task joins its documents into shards of bounded size, turns words into the numbers of the benchmark's vocabulary and
sorts all suffixes of the shard (prefix doubling in numpy). Every suffix of every test item is then binary-searched in the
shard, compared in full: its neighbours there give its longest verbatim match and the place. The windows of the suffixes that
match far enough have ranges of the array, which are all their places. What matches longest at each of these places is found
the other way round, in the suffix array of the test items. Words that no test item has split the shard, and a suffix too
short to hold a window is left out of the array, as it can match nothing; both are exact. Documents are read where they lie:
there is no shuffle.

The test side is made of arrays, built once on the driver and sent to all executors. A benchmark of more than BLOCK_WORDS
words is taken in blocks of about that size, one after the other: each block's finds are written before the next block is
read, and its arrays are dropped everywhere. The documents are then written once with row numbers, and the spans of a
document's hits are united afterwards. A shard's work grows with its words and its finds, never with pairs of places: a window
is expanded to its items once a document.

Defined cases: null or empty texts have no words, match nothing and are returned; items without words are no items; repeated
documents are each returned; repeated item ids count once; other columns are ignored; an empty benchmark hits nothing; a text
longer than a shard is a shard of its own; of equally long matches the first in the text is reported, and one of the items that
hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hands_back, materialise, small_batches

#: Bytes that are in words (digits, letters, all beyond ASCII), A-Z in lower case; any other becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 8
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1_000_000
#: Words that are compared at a time, and (document, item) pairs that are made at a time.
STEP = 8
SLICE = 1 << 20
SPANS = "row_id long, doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, longest long, longest_start long, longest_item string"
MATCHES = "item_id string, words long, item_start long, doc_id long, doc_start long"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then the same for first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def compared(a: np.ndarray, a_at: np.ndarray, a_left: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_left: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of a suffix of a and one of b: common first words (so many are known), and the sign of their order (an end sorts first)."""
    common = np.zeros(len(a_at), dtype=np.int64) if known is None else known.copy()
    sign, open_, step = np.zeros(len(a_at), dtype=np.int8), np.arange(len(a_at)), STEP
    while len(open_):
        columns = common[open_][:, None] + np.arange(step)
        x = np.where(columns < a_left[open_][:, None], a[np.minimum(a_at[open_][:, None] + columns, len(a) - 1)], 0)
        y = np.where(columns < b_left[open_][:, None], b[np.minimum(b_at[open_][:, None] + columns, len(b) - 1)], 0)
        stop = (x != y) | (x == 0)
        at, ended = stop.argmax(axis=1), stop.any(axis=1)
        common[open_] += np.where(ended, at, step)
        rows = np.flatnonzero(ended)
        sign[open_[rows]] = np.sign(x[rows, at[rows]].astype(np.int64) - y[rows, at[rows]])
        open_ = open_[~ended]
        step = max(STEP, min(2 * step, SLICE // max(len(open_), 1)))
    return common, sign


class Suffixes:
    """Sorted suffixes of a row of numbers in which 0 ends a run; a suffix ends with its run. starts: places, left: sizes."""

    def __init__(self, numbers: np.ndarray, starts: np.ndarray, left: np.ndarray):
        self.numbers, self.starts, self.left = numbers, starts, left

    @classmethod
    def sort(cls, numbers: np.ndarray, least: int | np.ndarray) -> Suffixes:
        """The suffixes with at least so many numbers (one bound, or one for each place); the last number must be 0."""
        stops = np.flatnonzero(numbers == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        runs = stops - starts >= (max(least, 1) if isinstance(least, int) else 1)  # shorter runs hold nothing that is wanted
        first, size = starts[runs], (stops - starts)[runs]
        live = ranges(first, size)
        left = np.zeros(len(numbers), dtype=np.int32)
        left[live] = np.repeat(first + size, size) - live
        # rank: place of the first of the suffixes that are equal so far, from 1 on; 0 at a run's end, where a shorter one sorts first
        order = live[np.argsort(numbers[live], kind="stable")]
        rank = np.zeros(len(numbers) + 1, dtype=np.int64)
        heads = np.ones(len(order), dtype=bool)
        heads[1:] = numbers[order[1:]] != numbers[order[:-1]]
        rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1] + 1
        step = 1
        while len(order):
            # still tied: of a group of two or more, and not yet compared up to their end
            alone = heads & np.concatenate([heads[1:], [True]])
            tied = np.flatnonzero(~alone)
            tied = tied[left[order[tied]] >= step]
            if not len(tied):
                break
            part = order[tied]
            one, two = rank[part], rank[part + np.minimum(left[part], step)]
            sorted_ = np.lexsort((two, one))
            part, one, two = part[sorted_], one[sorted_], two[sorted_]
            order[tied] = part
            fresh = np.ones(len(part), dtype=bool)
            fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            heads[tied] = fresh
            rank[part] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
            step *= 2
        kept = order[left[order] >= np.maximum(least if isinstance(least, int) else least[order], 1)]
        return cls(numbers, kept, left[kept])

    def _bound(self, other: np.ndarray, at: np.ndarray, left: np.ndarray, upper: bool) -> np.ndarray:
        """For each suffix of other (so many numbers of it) the first place whose suffix is not smaller; with upper, and does not begin with it."""
        lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(self.starts), dtype=np.int64)
        below, above = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)  # what the suffix shares with the places around its range
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            common, sign = compared(self.numbers, self.starts[mid], self.left[mid], other, at[open_], left[open_], np.minimum(below[open_], above[open_]))
            right = (sign < 0) | (upper & (common >= left[open_]))
            lo[open_[right]], below[open_[right]] = mid[right] + 1, common[right]
            hi[open_[~right]], above[open_[~right]] = mid[~right], common[~right]
        return lo

    def range_of(self, other: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffixes that begin with each row of numbers."""
        return self._bound(other, at, left, False), self._bound(other, at, left, True)

    def longest(self, other: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of other, searched in full: the most first numbers that a suffix here shares, and where that one is."""
        best, where = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        if len(self.starts):
            place = self._bound(other, at, left, False)
            for near in (place, place - 1):
                inside = np.flatnonzero((near >= 0) & (near < len(self.starts)))
                own = near[inside]
                common, _ = compared(self.numbers, self.starts[own], self.left[own], other, at[inside], left[inside])
                more = common > best[inside]
                best[inside[more]], where[inside[more]] = common[more], self.starts[own[more]]
        return best, where


class TestSide:
    """The items of one block as numbers, their sorted suffixes and distinct windows with the items that hold them: plain arrays."""

    __test__ = False

    def __init__(self, **held):
        vars(self).update(held)
        self.suffixes = Suffixes(self.numbers, self.starts, self.left)

    @staticmethod
    def build(items: list[tuple[str, str]], window: int) -> dict:
        """What TestSide() takes, as it is sent to executors."""
        vocabulary: dict[bytes, int] = {}
        names, parts = [], []
        for name, text in sorted(set(items)):
            if words := words_of(text):
                parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), dtype=np.int32, count=len(words)))
                names.append(name)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        numbers = np.zeros(max(1, int((sizes + 1).sum())), dtype=np.int32)
        for at, own in zip(first, parts, strict=True):
            numbers[at : at + len(own)] = own
        need = np.zeros(len(numbers), dtype=np.int32)
        need[ranges(first, sizes)] = np.repeat(np.minimum(sizes, window), sizes)
        found = Suffixes.sort(numbers, need)
        starts, left = found.starts, found.left
        own_need = need[starts]
        # Suffixes with the same window stand together; a whole short item is a window of its own size.
        fresh = np.ones(len(starts), dtype=bool)
        if len(starts) > 1:
            common, _ = compared(numbers, starts[:-1], left[:-1], numbers, starts[1:], np.minimum(left[1:], window))
            fresh[1:] = (own_need[1:] != own_need[:-1]) | (common < own_need[1:])
        window_of = np.cumsum(fresh) - 1
        item_of = np.searchsorted(first, starts, side="right") - 1
        codes = np.unique(window_of * max(len(names), 1) + item_of)
        holds, held = codes // max(len(names), 1), codes % max(len(names), 1)
        count = np.bincount(holds, minlength=int(fresh.sum()))
        return {
            "names": names, "vocabulary": vocabulary, "numbers": numbers, "first": first, "starts": starts, "left": left, "need": own_need, "window_of": window_of,
            "window_at": starts[fresh], "window_need": own_need[fresh], "items": held, "item_first": np.cumsum(count) - count, "item_count": count,
        }

    @property
    def shortest(self) -> int:
        return int(self.need.min())

    def item_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


class Shard:
    """Texts (numbers of their words) one after the other, a 0 behind each, with their sorted suffixes."""

    def __init__(self, texts: list[np.ndarray], least: int):
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        numbers = np.zeros(max(1, int(sizes.sum())), dtype=np.int32)
        for at, own in zip(self.first, texts, strict=True):
            numbers[at : at + len(own)] = own
        self.suffixes, self.stops = Suffixes.sort(numbers, least), np.flatnonzero(numbers == 0)

    def text_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def left_at(self, place: np.ndarray) -> np.ndarray:
        return self.stops[np.searchsorted(self.stops, place)] - place


def scan_shard(texts: list[np.ndarray], test: TestSide) -> list[tuple]:
    """For each text (numbers of its words): hit spans, items, and the longest verbatim match (words, start, item)."""
    out: list[tuple] = [([], [], 0, None, None) for _ in texts]
    if not len(test.starts) or not texts:
        return out
    shard = Shard(texts, test.shortest)
    longest, _ = shard.suffixes.longest(test.numbers, test.starts, test.left)
    present = np.unique(test.window_of[longest >= test.need])
    if not len(present):
        return out
    lo, hi = shard.suffixes.range_of(test.numbers, test.window_at[present], test.window_need[present])
    which = np.repeat(present, hi - lo)
    places = shard.suffixes.starts[ranges(lo, hi - lo)]
    change = np.zeros(len(shard.suffixes.numbers) + 1, dtype=np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, places + test.window_need[which], -1)
    covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(covered))  # spans never cross a text's end, as its 0 is never covered
    spans: dict[int, list] = {}
    for a, b, x in zip(edges[::2], edges[1::2], shard.text_at(edges[::2]), strict=True):
        spans.setdefault(int(x), []).append((int(a - shard.first[x]), int(b - shard.first[x])))
    # the items of each window, once a text
    held = np.unique(shard.text_at(places) * len(test.window_at) + which)
    text, which = held // len(test.window_at), held % len(test.window_at)
    ends, codes, at = np.cumsum(test.item_count[which]), np.zeros(0, dtype=np.int64), 0
    while at < len(which):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        count = test.item_count[which[at:stop]]
        own = test.items[ranges(test.item_first[which[at:stop]], count)]
        codes = np.union1d(codes, np.repeat(text[at:stop], count) * len(test.names) + own)
        at = stop
    items: dict[int, list[str]] = {}
    for x, k in zip((codes // len(test.names)).tolist(), (codes % len(test.names)).tolist(), strict=True):
        items.setdefault(x, []).append(test.names[k])
    # the longest match at each place, in the test side's own array
    places = np.unique(places)
    best, where = test.suffixes.longest(shard.suffixes.numbers, places, shard.left_at(places))
    text = shard.text_at(places)
    order = np.lexsort((places, -best, text))
    order = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
    for x, n, a, k in zip(text[order].tolist(), best[order].tolist(), places[order].tolist(), test.item_at(where[order]).tolist(), strict=True):
        out[x] = (spans[x], sorted(set(items[x])), n, a - int(shard.first[x]), test.names[k])
    return out


def match_items(texts: list[np.ndarray], test: TestSide) -> list[tuple[int, int, int, int, int]]:
    """For each item that matches: its number, words and start of its longest verbatim match, and the text and place where that is."""
    if not len(test.starts) or not texts:
        return []
    shard = Shard(texts, test.shortest)
    longest, where = shard.suffixes.longest(test.numbers, test.starts, test.left)
    hit = np.flatnonzero(longest >= test.need)
    item = test.item_at(test.starts[hit])
    order = np.lexsort((test.starts[hit], -longest[hit], item))
    order = order[np.concatenate([[True], item[order][1:] != item[order][:-1]])] if len(order) else order
    hit, item = hit[order], item[order]
    text = shard.text_at(where[hit])
    return list(zip(item.tolist(), longest[hit].tolist(), (test.starts[hit] - test.first[item]).tolist(), text.tolist(), (where[hit] - shard.first[text]).tolist(), strict=True))


def _shards(batches: Iterator[pd.DataFrame], vocabulary: dict[bytes, int], shard_words: int) -> Iterator[tuple[list, list]]:
    """Rows (row_id, doc_id) and texts as numbers, a shard at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for row, doc, text in zip(batch.row_id, batch.doc_id, batch.text, strict=True):
            words = words_of(text)
            rows.append((int(row), None if doc is None else int(doc)))
            texts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.int32, count=len(words)))
            size += len(words)
            if size >= shard_words:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _scanner(held, shard_words: int, every: bool):
    @hands_back
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = TestSide(**held.value)
        for rows, texts in _shards(batches, test.vocabulary, shard_words):
            found = [(r, d, len(t), [{"start": a, "stop": b} for a, b in s], i, n, p, k) for (r, d), t, (s, i, n, p, k) in zip(rows, texts, scan_shard(texts, test), strict=True) if every or n]
            yield pd.DataFrame(found, columns=["row_id", "doc_id", "n_words", "spans", "items", "longest", "longest_start", "longest_item"]).astype({"doc_id": "Int64", "longest_start": "Int64"})

    return scan


def _matcher(held, shard_words: int):
    @hands_back
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        test = TestSide(**held.value)
        for rows, texts in _shards(batches, test.vocabulary, shard_words):
            found = [(test.names[k], n, j, rows[x][1], p) for k, n, j, x, p in match_items(texts, test)]
            yield pd.DataFrame(found, columns=["item_id", "words", "item_start", "doc_id", "doc_start"]).astype({"doc_id": "Int64"})

    return match


def _test_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[int, Iterator[dict]]:
    """How many blocks the benchmark has, and their test sides, each read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-int(words) // block_words))
    return n, (TestSide.build([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()], window) for k in range(n))


def _texts(docs: DataFrame, row_id) -> DataFrame:
    return docs.select(row_id.alias("row_id"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document with its hit spans (words), the items found and the longest verbatim match with its place."""
    spark = docs.sparkSession
    small_batches(spark)
    n, blocks = _test_blocks(benchmark, window, block_words)
    if n == 1:
        held = spark.sparkContext.broadcast(next(blocks))
        return _texts(docs, F.lit(0).cast("long")).mapInPandas(_scanner(held, shard_words, True), SPANS).drop("row_id")
    rows, whole = materialise(_texts(docs, F.monotonically_increasing_id()), "rows"), None
    for test in blocks:
        held = spark.sparkContext.broadcast(test)
        found = materialise(rows.mapInPandas(_scanner(held, shard_words, whole is None), SPANS), "hits")
        held.destroy()
        whole = found if whole is None else whole.unionByName(found)
    discard(rows)
    longest = F.max(F.struct("longest", -F.col("longest_start"), "longest_start", "longest_item")).alias("best")
    united = whole.groupBy("row_id", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), longest)
    empty = "cast(array() as array<struct<start:bigint,stop:bigint>>)"
    joined = "array(named_struct('start', element_at(kept, -1).start, 'stop', greatest(element_at(kept, -1).stop, s.stop)))"
    merged = F.expr(f"aggregate(spans, {empty}, (kept, s) -> if(size(kept) > 0 and s.start <= element_at(kept, -1).stop, concat(slice(kept, 1, size(kept) - 1), {joined}), concat(kept, array(s))))")
    return united.select("doc_id", "n_words", merged.alias("spans"), "items", "best.longest", "best.longest_start", "best.longest_item")


def item_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each item that matches: words of its longest verbatim match in all documents, where that starts in it, and in which document and where there."""
    spark, found = docs.sparkSession, None
    small_batches(spark)
    for test in _test_blocks(benchmark, window, block_words)[1]:
        held = spark.sparkContext.broadcast(test)
        here = materialise(_texts(docs, F.lit(0).cast("long")).mapInPandas(_matcher(held, shard_words), MATCHES), "matches")
        held.destroy()
        found = here if found is None else found.unionByName(here)
    best = F.min(F.struct((-F.col("words")).alias("less"), "doc_id", "doc_start", "item_start")).alias("b")
    return found.groupBy("item_id").agg(best).select("item_id", (-F.col("b.less")).alias("words"), "b.item_start", "b.doc_id", "b.doc_start")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, **how) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, then the longest match."""
    found = find_matches(docs, benchmark, **how)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    longest = [F.col("longest").alias("longest_match"), F.col("longest_start").alias("longest_match_start"), F.col("longest_item").alias("longest_match_item")]
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), *longest)
