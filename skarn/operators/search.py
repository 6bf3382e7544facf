"""Full-text search: tokens, postings, a stored inverted index, BM25 and TF-IDF, prefixes, near spellings, phrases, facets, highlights."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stems import stem, stop_words

#: A token: ASCII letters and digits and the Latin letters up to U+024F.
TOKEN = r"[a-zA-Z0-9À-ɏ]+"
K1, B = 1.2, 0.75
#: Documents whose postings are put in order together: as many as have so many tokens.
BLOCK = 1_000_000
#: A list of wanted terms up to so many rows goes to all executors.
BROADCAST_ROWS = 100_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenised(df: DataFrame, kept: list[Column], words: dict[str, Column]) -> DataFrame:
    """kept, and each text's tokens under its name. A generator of one row, which filters and projections stay above: each text is
    cut into tokens once, however often they are used."""
    return df.select(*kept, F.inline(F.array(F.struct(*[tokens(c).alias(name) for name, c in words.items()]))))


def occurrences(words: Column, word: str | Column) -> Column:
    return F.size(words) - F.size(F.array_remove(words, word))


def postings(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """key, term, tf and positions of every term of every text."""
    words = df.select(F.col(f"`{key}`"), F.posexplode(tokens(F.col(f"`{text}`"))).alias("pos", "term"))
    if stop:
        words = words.where(~F.col("term").isin(list(stop)))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """term, its count and the documents that hold it.

    A document's tokens are sorted, so that the first of each term is marked inside the row: one generator, one sum per term in the
    tasks, and one shuffle of distinct terms.
    """
    rows = df.select(F.sort_array(tokens(F.col(f"`{text}`"))).alias("words"))
    once = F.transform("words", lambda w, i: F.struct(w.alias("term"), (~F.coalesce(F.get("words", i - 1) == w, F.lit(False))).cast("long").alias("first")))
    return rows.select(F.explode(once).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.count("*").alias("n"), F.sum("x.first").alias("df"))


def inverted(fields: list[str], left_out: list[str]) -> Callable[[Iterator], Iterator]:
    """Batches of documents (key, tokens of each field, perhaps forms and stems of these) to rows of a TextIndex, block by block."""

    def block(table: pa.Table) -> pa.RecordBatch:
        flat = lambda name: pa.concat_arrays([c.flatten() for c in table[name].chunks])
        keys, documents = table["key"].combine_chunks(), np.arange(table.num_rows)
        counts = [pc.list_value_length(table[f"words_{i}"]).to_numpy() for i in range(len(fields))]
        words = pa.concat_arrays([flat(f"words_{i}") for i in range(len(fields))])
        field = np.repeat(np.arange(len(fields)), [int(c.sum()) for c in counts])
        document = np.concatenate([np.repeat(documents, c) for c in counts])
        position = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in counts])
        if left_out:
            kept = np.flatnonzero(~pc.is_in(words, value_set=pa.array(left_out, words.type)).to_numpy(zero_copy_only=False))
            words, field, document, position = words.take(pa.array(kept)), field[kept], document[kept], position[kept]
        if "stems" in table.column_names:
            forms = flat("forms").dictionary_encode()
            first = np.unique(forms.indices.to_numpy(), return_index=True)[1]
            words = flat("stems").take(pa.array(first)).take(pc.index_in(words, value_set=forms.dictionary))
        terms = words.dictionary_encode()
        code = terms.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # by term, then as they stand: by field, document and position
        code, field, document, position = code[order], field[order], document[order], position[order]
        differs = lambda *columns: np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])])) if len(columns[0]) else np.zeros(0, int)
        posting = differs(code, field, document)
        row = differs(code[posting], field[posting])
        start = np.append(posting[row], len(code))
        ends = np.append(posting[1:], len(code))[: len(posting)] - np.repeat(start[:-1], np.diff(np.append(row, len(posting))))
        pairs = code[posting].astype(np.int64) * len(documents) + document[posting]
        pairs = np.unique(pairs[keys.is_valid().to_numpy(zero_copy_only=False)[document[posting]]])
        docs = np.bincount(pairs // max(len(documents), 1), minlength=len(terms.dictionary))[code[start[:-1]]]
        docs[1:] *= code[start[1:-1]] != code[start[:-2]]  # a term's documents stand in the first of its fields
        lengths = np.bincount(document, minlength=len(documents))
        lists = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        columns = [
            pa.concat_arrays([pa.array([""], words.type), terms.dictionary.take(pa.array(code[start[:-1]]))]),
            pa.array(["", *np.array(fields, object)[field[start[:-1]]]], pa.string()),
            pa.array(np.append(0, docs), pa.int64()),
            pa.array(np.append(len(code), np.diff(start)), pa.int64()),
            lists(keys.take(pa.array(np.append(documents, document[posting]))), np.concatenate([[0], row + len(documents), [len(documents) + len(posting)]])),
            lists(pa.array(np.append(lengths, ends), pa.int32()), np.concatenate([[0], row + len(documents), [len(documents) + len(posting)]])),
            lists(pa.array(position, pa.int32()), np.append(0, start)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "field", "docs", "n", "keys", "ends", "positions"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + sum(len(batch[f"words_{i}"].flatten()) for i in range(len(fields)))
            if n >= BLOCK:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return blocks


@dataclass
class Part:
    """One part of a query: a word, a phrase (in order), a prefix or a near word, perhaps of one field, perhaps excluded."""

    kind: str
    words: list[str]
    field: str | None = None
    excluded: bool = False


@dataclass
class TextQuery:
    """The parts of a query, and whether all of them must match."""

    parts: list[Part] = field(default_factory=list)
    every: bool = True

    def of(self, kind: str, excluded: bool = False) -> list[list[str]]:
        return [p.words for p in self.parts if p.kind == kind and p.excluded == excluded]


def parse(query: str) -> TextQuery:
    """word, "a phrase", -part, NOT part, field:part, pre*, near~, AND, OR (any OR makes the whole query OR)."""
    out, negate = TextQuery(), False
    for token in re.findall(r'-?(?:\w+:)?"[^"]*"|\S+', query):
        if token in ("AND", "OR", "NOT"):
            out.every, negate = out.every and token != "OR", token == "NOT"
            continue
        excluded, token = negate or token.startswith("-"), token.removeprefix("-")
        negate = False
        name = re.match(r'(\w+):(?=[^\s:])', token)
        token = token[name.end() :] if name else token
        kind = "phrase" if token.startswith('"') else "prefix" if token.endswith("*") else "near" if token.endswith("~") else "word"
        words = re.findall(TOKEN, token.lower())
        if not words:
            continue
        if kind == "word" and len(words) > 1:
            kind = "phrase"  # a-b is two tokens next to each other
        elif kind in ("prefix", "near"):
            words = words[:1]
        out.parts.append(Part(kind, words, name[1] if name else None, excluded))
    return out


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, df: Column, n_docs: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n_docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def tf_idf(tf: Column, df: Column, n_docs: Column, length: Column | None = None, mean: Column | None = None) -> Column:
    """1 + ln tf, times a smooth inverse document frequency."""
    return (1 + F.log(tf)) * (F.log((n_docs + 1) / (df + 1)) + 1)


def bm25(df: DataFrame, key: str, text: str, words: list[str], every: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """key and score of the documents that hold any (or every) word, without an index: two scans and no shuffle of postings.

    The first scan counts documents, tokens and the documents of each word. The second leaves out texts without any of the words as
    they stand, before it cuts the others into tokens, and adds each document's own words up.
    """
    wanted = sorted(set(words))
    held = [F.count_if(F.array_contains("words", F.lit(w))).alias(f"df_{i}") for i, w in enumerate(wanted)]
    about = tokenised(df, [], {"words": F.col(f"`{text}`")}).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("mean"), *held).first()
    near = df.where(reduce(lambda x, y: x | y, [F.lower(F.col(f"`{text}`")).contains(w) for w in wanted], F.lit(False)))
    rows = tokenised(near, [F.col(f"`{key}`")], {"words": F.col(f"`{text}`")})
    rows = rows.select(key, F.size("words").alias("len"), F.array(*[occurrences(F.col("words"), w) for w in wanted]).cast("array<int>").alias("tf"))
    weights = F.array(*[F.lit(float(_idf(about["n"], about[f"df_{i}"]))) for i in range(len(wanted))])
    size = 1 - b + b * F.col("len") / F.lit(about["mean"] or 1.0)
    parts = F.zip_with("tf", weights, lambda tf, w: F.when(tf > 0, w * tf * (k1 + 1) / (tf + k1 * size)).otherwise(0.0))
    scored = rows.select(key, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("score"), F.size(F.filter("tf", lambda x: x > 0)).cast("long").alias("matched"))
    return scored.where(F.col("matched") == len(wanted) if every else F.col("matched") > 0)


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def prefix_terms(terms: DataFrame, prefix: str) -> DataFrame:
    return terms.where(F.col("term").startswith(prefix))


def near_terms(terms: DataFrame, word: str, edits: int = 2, shared: int = 0) -> DataFrame:
    """Terms within so many edits that share the first letters, with boost 1 / (edits + 1)."""
    close = terms.where(F.abs(F.length("term") - len(word)) <= edits)
    if shared:
        close = close.where(F.substring("term", 1, shared) == word[:shared])
    return close.withColumn("edits", F.levenshtein(F.col("term"), F.lit(word))).where(F.col("edits") <= edits).withColumn("boost", 1 / (F.col("edits") + 1))


def holds_phrase(text: Column, words: list[str]) -> Column:
    """Whether the words stand next to each other in the text."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


class TextIndex:
    """A stored inverted index over weighted fields: postings in segments, a term table, lengths and totals.

    Each task that reads documents writes one segment, sorted by term, so postings are never shuffled and a search reads, of every
    segment, only the row groups and pages of its terms. A row has the postings of a term in one field of a block of documents: their
    keys, where each one's positions end, and the positions one document after the other; the empty term has all documents of a block
    and, as ends, their lengths. Stems are made of distinct terms. Statistics are those of the whole corpus, whatever a search filters.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = json.loads(spark.read.text(f"{self.folder}/about", wholetext=True).first()[0])
        self.key, self.weights, self.language, self.repeats, self.n_docs, self.mean = (about[k] for k in ("key", "weights", "language", "repeats", "n_docs", "mean"))

    @classmethod
    def build(cls, df: DataFrame, key: str, fields: dict[str, float], folder: str, language: str = "none", stop: list[str] | None = None) -> TextIndex:
        spark, folder = df.sparkSession, folder.rstrip("/")
        left_out = stop_words(language) if stop is None else stop
        words = tokenised(df, [F.col(f"`{key}`").alias("key")], {f"words_{i}": F.col(f"`{f}`").cast("string") for i, f in enumerate(fields)})
        if language != "none":
            words = words.withColumn("forms", F.array_distinct(F.concat(*[f"words_{i}" for i in range(len(fields))])))
            words = words.withColumn("stems", F.transform("forms", lambda w: stem(w, language)))
        kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
        rows = words.mapInArrow(inverted(list(fields), left_out), f"term string, field string, docs long, n long, keys array<{kind}>, ends array<int>, positions array<int>")
        rows.sortWithinPartitions("term", "field").write.parquet(f"{folder}/postings")
        stored = spark.read.parquet(f"{folder}/postings")
        lengths = stored.where("term = ''").select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("ends").alias("len"))))
        lengths.groupBy("key").agg(F.sum("len").alias("len"), F.count("*").alias("rows")).write.parquet(f"{folder}/lengths")
        about = spark.read.parquet(f"{folder}/lengths").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0)), F.max(F.when(F.col("key").isNotNull(), F.col("rows")))).first()
        repeats, held = (about[2] or 0) > 1, stored.where("term > ''")
        if repeats:  # blocks do not know each other's documents
            one = held.select("term", F.explode("keys").alias("key")).groupBy("term").agg(F.count_distinct("key").alias("df"))
            terms = held.groupBy("term").agg(F.sum("n").alias("n")).join(one, "term").select("term", "df", "n")
        else:
            terms = held.groupBy("term").agg(F.sum("docs").alias("df"), F.sum("n").alias("n"))
        terms.sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        about = {"key": key, "weights": fields, "language": language, "repeats": repeats, "n_docs": about[0], "mean": about[1] / about[0] if about[0] else 0.0}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")
        return cls(spark, folder)

    def terms(self) -> DataFrame:
        """term, documents that hold it and its count."""
        return self.spark.read.parquet(f"{self.folder}/terms")

    def _wanted(self, query: TextQuery, edits: int) -> tuple[DataFrame, Column]:
        """number of the part, term, boost, place in a phrase and documents of every term that a part of the query means; and what holds
        for all these terms and lets a reader of sorted terms leave out most others."""
        exact = [(i, w, 1.0, k) for i, p in enumerate(query.parts) if p.kind in ("word", "phrase") for k, w in enumerate(p.words)]
        rows = self.spark.createDataFrame(exact, "n int, term string, boost double, place int")
        out = rows.select("n", stem(F.col("term"), self.language).alias("term"), "boost", "place")
        among = F.col("term").isin(sorted({r["term"] for r in out.select("term").collect()}))  # the query's own words
        for i, p in enumerate(query.parts):
            if p.kind == "prefix":
                found = prefix_terms(self.terms(), p.words[0]).select(F.lit(i).alias("n"), "term", F.lit(1.0).alias("boost"), F.lit(0).alias("place"))
                out, among = out.unionByName(found), among | F.col("term").startswith(p.words[0])
            elif p.kind == "near":
                found = near_terms(self.terms(), p.words[0], edits).select(F.lit(i).alias("n"), "term", "boost", F.lit(0).alias("place"))
                out, among = out.unionByName(found), among | (F.abs(F.length("term") - len(p.words[0])) <= edits)
        return out.join(self.terms().where(among).select("term", "df"), "term"), among

    def _hits(self, query: TextQuery, edits: int) -> DataFrame:
        """The postings of the terms that the parts of a query mean, with positions if it has a phrase."""
        wanted, among = self._wanted(query, edits)
        held = self.spark.read.parquet(f"{self.folder}/postings").where(among & (F.col("term") > "")).drop("docs", "n")
        hits = held.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "term")
        for i, p in enumerate(query.parts):
            if p.field is not None:
                hits = hits.where((F.col("n") != i) | (F.col("field") == p.field))
        before = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
        one = {"key": lambda k, i: k, "tf": lambda k, i: F.get("ends", i) - before(i)}
        if any(p.kind == "phrase" for p in query.parts):
            one["positions"] = lambda k, i: F.slice("positions", before(i) + 1, F.get("ends", i) - before(i))
        names = ["n", "boost", "place", "df", "field", "term"]
        hits = hits.select(*names, F.inline(F.transform("keys", lambda k, i: F.struct(*[f(k, i).alias(name) for name, f in one.items()]))))
        if self.repeats:
            hits = hits.groupBy(*names, "key").agg(F.sum("tf").alias("tf"), *[F.flatten(F.collect_list("positions")).alias("positions")] * ("positions" in one))
        return hits

    def search(
        self, query: str | TextQuery, limit: int | None = 10, offset: int = 0, docs: DataFrame | None = None, where: Column | None = None, exact_boost: float | None = None,
        scorer: Callable[..., Column] = bm25_weight, edits: int = 2,
    ) -> DataFrame:
        """key and score, best first, ties by key. docs (with the key) is needed for where and for exact_boost.

        A document must match every part, or with OR any; the terms of a prefix or a near word are one part. A phrase's words stand next
        to each other in one field. exact_boost multiplies a word's score where a field's whole value is that word.
        """
        q = parse(query) if isinstance(query, str) else query
        name = self.key
        if not [p for p in q.parts if not p.excluded]:
            empty = self.spark.read.parquet(f"{self.folder}/lengths").limit(0)
            return empty.select(F.col("key").alias(name), F.lit(0.0).alias("score"))
        hits = self._hits(q, edits)
        for i, p in enumerate(q.parts):
            if p.kind == "phrase":
                hits = hits.where(F.col("n") != i).unionByName(self._phrase(hits.where(F.col("n") == i), len(p.words)))
        bad = [i for i, p in enumerate(q.parts) if p.excluded]
        good = [i for i, p in enumerate(q.parts) if not p.excluded]
        excluded = hits.where(F.col("n").isin(bad)).select("key").distinct() if bad else None
        hits = hits.where(F.col("n").isin(good))
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        hits = hits.join(lengths.select("key", "len"), "key")
        weights = F.create_map(*[F.lit(x) for f, w in self.weights.items() for x in (f, float(w))])
        weight = scorer(F.col("tf"), F.col("df"), F.lit(self.n_docs), F.col("len"), F.lit(self.mean or 1.0))
        hits = hits.withColumn("score", weight * F.element_at(weights, F.col("field")) * F.col("boost"))
        if exact_boost is not None and docs is not None:
            values = F.array(*[F.lower(F.col(f"`{f}`").cast("string")) for f in self.weights])
            hits = hits.join(docs.select(F.col(f"`{name}`").alias("key"), values.alias("values")), "key")
            spoken = F.create_map(*[x for i, p in enumerate(q.parts) for x in (F.lit(i), F.lit(" ".join(p.words)))])
            hits = hits.withColumn("score", F.col("score") * F.when(F.array_contains("values", F.element_at(spoken, F.col("n"))), exact_boost).otherwise(1.0))
        scored = hits.groupBy("key").agg(F.sum("score").alias("score"), F.count_distinct("n").alias("matched"))
        if q.every:
            scored = scored.where(F.col("matched") == len(good))
        if excluded is not None:
            scored = scored.join(excluded, "key", "left_anti")
        scored = scored.select(F.col("key").alias(name), F.round("score", 9).alias("score"))  # so that ties are ties
        if where is not None and docs is not None:
            scored = scored.join(docs.where(where).select(F.col(f"`{name}`")), name, "left_semi")
        ranked = scored.orderBy(F.desc("score"), name)
        ranked = ranked.offset(offset) if offset else ranked
        return ranked if limit is None else ranked.limit(limit)

    def _phrase(self, hits: DataFrame, size: int) -> DataFrame:
        """The hits of a phrase in the fields where its words stand in order, next to each other."""
        starts = F.transform("positions", lambda p: p - F.col("place"))
        whole = hits.select("key", "field", "place", starts.alias("starts")).groupBy("key", "field").agg(F.collect_list(F.struct("place", "starts")).alias("x"))
        first = F.filter("x", lambda e: e["place"] == 0)
        others = lambda s: F.forall("x", lambda e: F.array_contains(e["starts"], s))
        found = whole.where((F.size("x") == size) & F.exists(F.flatten(F.transform(first, lambda e: e["starts"])), others))
        return hits.join(found.select("key", "field"), ["key", "field"], "left_semi").select(*hits.columns)


def _means(p: Part, word: Column) -> Column:
    """Whether a token is one that a part of a query means."""
    if p.kind == "prefix":
        return word.startswith(p.words[0])
    return F.levenshtein(word, F.lit(p.words[0]), 2) >= 0 if p.kind == "near" else word.isin(sorted(set(p.words)))


def _holds(words: Column, p: Part) -> Column:
    """Whether a document's tokens have what a part of a query means."""
    if p.kind == "near":
        return F.exists(words, lambda w: _means(p, w))
    if p.kind == "word":
        return F.array_contains(words, F.lit(p.words[0]))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(p.words) + (" " if p.kind == "phrase" else ""))


def _may_hold(text: Column, p: Part) -> Column:
    """Whether the text as it stands has the words of a part, perhaps within others; true where that tells nothing."""
    if p.kind == "near":
        return F.lit(True)
    return reduce(lambda a, b: a & b, [F.lower(text).contains(w) for w in p.words])


def search(df: DataFrame, key: str, text: str, query: str, limit: int | None = 10) -> DataFrame:
    """Ranked documents of a query over one text without a stored index, by the rules of TextIndex.search(); ties by key.

    Statistics are those of all documents. A part of another field restricts the documents and adds nothing to their scores. All that
    concerns a document is found within its row: texts that cannot match are left out as they stand, the others cut into tokens once,
    and only keys and scores are shuffled. What a prefix or a near word means is a list of terms of any length, joined.
    """
    q = parse(query)
    texts = {f: F.col(f"`{f}`") for f in {text} | {p.field for p in q.parts if p.field}}
    own, of = F.col(f"words_{text}"), lambda p: F.col(f"words_{p.field or text}")
    cut = lambda rows: tokenised(rows, [F.col(f"`{key}`").alias("key")], {f"words_{f}": c for f, c in texts.items()})
    scoring = [p for p in q.parts if not p.excluded and p.field in (None, text)]
    may = [_may_hold(texts[text], p) for p in scoring]
    near = df
    for p in q.parts:
        if not p.excluded and p.field not in (None, text):
            near = near.where(_may_hold(texts[p.field], p))
    if scoring:
        near = near.where(reduce((lambda a, b: a & b) if q.every else (lambda a, b: a | b), may))
    kept = cut(near)
    for p in q.parts:
        if p.excluded or p.field not in (None, text):
            kept = kept.where(~_holds(of(p), p) if p.excluded else _holds(of(p), p))
    if not scoring:
        ranked = kept.select(F.col("key").alias(key), F.lit(0.0).alias("score")).orderBy(key)
        return ranked if limit is None else ranked.limit(limit)
    listed = sorted({w for p in scoring if p.kind in ("word", "phrase") for w in p.words})
    held = [F.count_if(F.array_contains("words", F.lit(w))) for w in listed]
    about = tokenised(df, [], {"words": texts[text]}).agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)), *held).first()
    weight = lambda tf, df, length: bm25_weight(tf, df, F.lit(about[0]), length, F.lit(about[1] or 1.0))
    # a part counts for a document only if the document holds all of it, as a phrase's words next to each other
    whole = kept.where("key is not null").select("key", F.size(own).alias("len"), own.alias("own"), F.array(*[_holds(own, p) for p in scoring]).alias("whole"))
    whole = whole.where(F.forall("whole", lambda x: x) if q.every else F.exists("whole", lambda x: x))
    if all(p.kind in ("word", "phrase") for p in scoring):
        tf = {w: F.get(F.col("tf"), F.lit(i)) for i, w in enumerate(listed)}
        counted = whole.select("key", "len", "whole", F.array(*[occurrences(F.col("own"), w) for w in listed]).alias("tf"))
        parts = [F.when(F.get("whole", F.lit(i)), weight(tf[w], F.lit(about[2 + listed.index(w)]), F.col("len"))).otherwise(0.0) for i, p in enumerate(scoring) for w in p.words]
        hits = counted.select("key", reduce(lambda a, b: a + b, parts).alias("score"))
    else:
        any_part = lambda w: reduce(lambda a, b: a | b, [_means(p, w) for p in scoring])
        asked = tokenised(df.where(reduce(lambda a, b: a | b, may)), [], {"words": texts[text]}).select(F.filter("words", any_part).alias("asked"))
        terms = asked.select(F.explode(F.array_distinct("asked")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        rows = whole.select("key", "len", "whole", F.filter("own", any_part).alias("asked"))

        def found(i: int, p: Part) -> Column:
            """The part's terms in the document, with their counts; a word that a phrase has twice counts twice."""
            said = F.array(*map(F.lit, p.words)) if p.kind in ("word", "phrase") else F.filter(F.array_distinct("asked"), lambda w: _means(p, w))
            boost = (lambda w: 1 / (F.levenshtein(w, F.lit(p.words[0])) + 1)) if p.kind == "near" else (lambda w: F.lit(1.0))
            each = F.transform(said, lambda w: F.struct(w.alias("term"), occurrences(F.col("asked"), w).alias("tf"), boost(w).alias("boost")))
            return F.when(F.get("whole", F.lit(i)), each).otherwise(F.slice(each, 1, 0))

        each = rows.select("key", "len", F.inline(F.concat(*[found(i, p) for i, p in enumerate(scoring)])))
        hits = each.join(terms, "term").select("key", (weight(F.col("tf"), F.col("df"), F.col("len")) * F.col("boost")).alias("score"))
    scored = hits.groupBy("key").agg(F.sum("score").alias("score"))
    ranked = scored.select(F.col("key").alias(key), F.round("score", 9).alias("score")).orderBy(F.desc("score"), key)
    return ranked if limit is None else ranked.limit(limit)


def facets(hits: DataFrame, name: str) -> DataFrame:
    return hits.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def highlighted(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    pattern = "(?i)(?<![a-zA-Z0-9À-ɏ])(" + "|".join(re.escape(w) for w in words) + ")(?![a-zA-Z0-9À-ɏ])"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")


def snippet(text: Column, word: str, around: int = 40) -> Column:
    """The text around the first place of a word."""
    at = F.instr(F.lower(text), word)
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(2 * around + len(word))))
