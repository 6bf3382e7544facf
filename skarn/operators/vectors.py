"""Vector search: exact top-k, batches, filters before or after, rank fusion, clustered search with measured recall."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import distance
from .chains import Chain

#: So many queries of a batch are compared at once with a task's rows.
BLOCK = 256


def top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest rows (ties by key): a top-k without a full sort; where filters before."""
    rows = df.where(where) if where is not None else df
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, distance(F.col(vector), q, metric).alias("distance")).orderBy("distance", key).limit(k)


def top_k_then(df: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column, metric: str = "cosine", over: int = 3, whole: bool = False) -> DataFrame:
    """The nearest k of those among the over * k nearest for which where holds, so fewer than k where the filter takes many.

    With whole, twice as many are looked at until k hold or no row is left: the same as filtering before.
    """
    rows = df.where(where).select(key)
    while True:
        near = top_k(df, key, vector, query, over * k, metric)
        found = rows.join(F.broadcast(near), key).orderBy("distance", key).limit(k)
        if not whole or found.count() >= k or near.count() < over * k:
            return found
        over *= 2


def batch_top_k(
    df: DataFrame, key: str, vector: str, queries: dict[int, list[float]], k: int, metric: str = "cosine", probed: dict[int, list[int]] | None = None,
    coded: tuple[np.ndarray, list[np.ndarray], int] | None = None,
) -> DataFrame:
    """query, key, distance and rank of the k nearest rows of each query, a stated set that goes to all tasks.

    A task multiplies its rows with BLOCK queries at once and keeps k a query, so k rows a query and task are shuffled. With
    probed, a query reads only the rows whose list is among its own. With coded (centres, codebooks, how many), only so many rows of
    a batch and list are compared whole for a query, the best by their codes: by tables of what each code adds to the distance.
    """
    names = sorted(queries)
    table = np.array([queries[n] for n in names], dtype=np.float64)
    kind = dict(df.dtypes)[key]

    asking: dict[int, list[int]] = {}
    for i, n in enumerate(names):
        for number in probed[n] if probed is not None else ():
            asking.setdefault(number, []).append(i)
    block = BLOCK

    def run(batches):
        best: list[list[tuple[float, int]]] = [[] for _ in names]

        def chosen(i, codes, number):
            """The rows of a list that are best for a query by their codes."""
            centres, books, many = coded
            if len(codes) <= many:
                return np.arange(len(codes))
            q = table[i] / (np.linalg.norm(table[i]) or 1.0) if metric == "cosine" else table[i]
            rest = np.array_split(q - centres[number], len(books))
            apart = [((book - part) ** 2).sum(1) for book, part in zip(books, rest, strict=True)]
            return np.sort(np.argpartition(sum(a[codes[:, j]] for j, a in enumerate(apart)), many - 1)[:many])

        def keep(x, keys, own):
            for first in range(0, len(own), block):
                part = own[first : first + block]
                some = table[part]
                if metric == "cosine":
                    size = np.linalg.norm(some, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    d = 1 - np.divide(some @ x.T, size, out=np.zeros_like(size), where=size > 0)
                elif metric == "dot":
                    d = -(some @ x.T)
                else:
                    d = np.maximum((some**2).sum(1)[:, None] - 2 * some @ x.T + (x**2).sum(1)[None, :], 0)
                    d = d if metric == "l2sq" else np.sqrt(d)
                for row, i in enumerate(part):
                    near = np.lexsort((keys, d[row]))[:k]
                    held = {}  # a row may lie in several lists
                    for distance_, name in sorted(best[i] + [(float(d[row][j]), keys[j]) for j in near]):
                        held.setdefault(name, distance_)
                    best[i] = [(distance_, name) for name, distance_ in held.items()][:k]

        for batch in batches:
            if len(batch):
                x, keys = np.stack(batch[vector].to_list()).astype(np.float64), batch[key].to_numpy()
                if probed is None:
                    keep(x, keys, list(range(len(names))))
                else:
                    lists = batch["list"].to_numpy()
                    for number in np.unique(lists).tolist():
                        here = lists == number
                        if coded is None:
                            keep(x[here], keys[here], asking.get(number, []))
                            continue
                        codes = np.stack(batch["code"][here].to_list()).astype(np.int64)
                        for i in asking.get(number, []):
                            rows = chosen(i, codes, number)
                            keep(x[here][rows], keys[here][rows], [i])
        yield pd.DataFrame([(n, b[1], b[0]) for n, found in zip(names, best, strict=True) for b in found], columns=["query", key, "distance"])

    more = (["list"] if probed is not None else []) + (["code"] if coded is not None else [])
    near = df.select(key, vector, *more).mapInPandas(run, f"query long, {key} {kind}, distance double")
    if probed is not None:
        near = near.groupBy("query", key).agg(F.min("distance").alias("distance"))
    window = Window.partitionBy("query").orderBy("distance", key)
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def fused(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists with columns key and rank (from 1)."""
    rows = lists[0].select(key, "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def recall(found: DataFrame, exact: DataFrame, keys: list[str]) -> float:
    """The share of exact results that were found."""
    hit, all_ = exact.join(found.select(*keys), keys, "left_semi").count(), exact.count()
    return hit / all_ if all_ else 1.0


def average_precision(found: DataFrame, exact: DataFrame, query: str, key: str, rank: str = "rank") -> DataFrame:
    """query and ap: the mean, over a query's exact results, of the precision at each rank where one was found (0 for those missed)."""
    window = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    hits = found.select(query, key, rank).join(exact.select(query, key).withColumn("hit", F.lit(1)), [query, key], "left")
    at = hits.withColumn("share", F.sum(F.coalesce("hit", F.lit(0))).over(window) / F.col(rank)).where("hit = 1")
    total = exact.groupBy(query).agg(F.count("*").alias("total"))
    return total.join(at.groupBy(query).agg(F.sum("share").alias("sum")), query, "left").select(query, (F.coalesce("sum", F.lit(0.0)) / F.col("total")).alias("ap"))


def kmeans(sample: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Centres of a sample; a centre that loses all its rows stays where it is. Rows are compared in blocks."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([nearest_centre(sample[i : i + 8192], centres) for i in range(0, len(sample), 8192)])
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


class ClusterIndex:
    """Vectors stored by the nearest few of some centres, each with a short code of what the centre lacks (product quantisation).

    Centres and codebooks are fitted on a bounded sample; every row is indexed, into a folder with one part for each list. With
    `copies`, a row lies in that many lists, which costs room and finds neighbours across the borders of lists. A search reads the
    lists of the nearest few centres, takes the best by code and orders these by their whole vectors.
    """

    SAMPLE = 20_000

    def __init__(self, spark, folder: str, centres: np.ndarray, books: list[np.ndarray], key: str, vector: str, metric: str):
        self.spark, self.folder, self.centres, self.books, self.key, self.vector, self.metric = spark, folder, centres, books, key, vector, metric

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, folder: str, lists: int = 64, copies: int = 3, parts: int = 8, codes: int = 16, rounds: int = 20, seed: int = 7, metric: str = "l2sq") -> ClusterIndex:
        """Cosine search works on vectors of length 1, whose squared l2 distance orders them alike."""
        spark, folder = df.sparkSession, folder.rstrip("/")
        taken = df.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h")).orderBy("h", vector).limit(cls.SAMPLE).select(vector).collect()
        sample = cls._ready(np.array([r[0] for r in taken], dtype=np.float64), metric)
        centres = kmeans(sample, lists, rounds, seed)
        rest = sample - centres[nearest_centre(sample, centres)]
        books = [kmeans(x, codes, rounds, seed) for x in np.array_split(rest, min(parts, rest.shape[1]), axis=1)]
        index = cls(spark, folder, centres, books, key, vector, metric)
        index.coded(df, copies).repartition("list").write.partitionBy("list").parquet(f"{folder}/rows")
        return index

    @staticmethod
    def _ready(x: np.ndarray, metric: str) -> np.ndarray:
        if metric != "cosine":
            return x
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def coded(self, df: DataFrame, copies: int = 1) -> DataFrame:
        """df with each row's list and code, a row for each of its nearest lists."""
        centres, books, vector, metric, ready = self.centres, self.books, self.vector, self.metric, self._ready

        @F.pandas_udf("array<struct<list:int,code:array<int>>>")
        def places(v: pd.Series) -> pd.Series:
            x = ready(np.stack(v.to_list()).astype(np.float64), metric)
            apart = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
            near = np.argsort(apart, axis=1, kind="stable")[:, :copies]
            out = [[] for _ in range(len(x))]
            for own in near.T:
                cut = np.array_split(x - centres[own], len(books), axis=1)
                code = np.stack([nearest_centre(part, book) for part, book in zip(cut, books, strict=True)], axis=1)
                for row, number, c in zip(out, own.tolist(), code.tolist(), strict=True):
                    row.append({"list": number, "code": c})
            return pd.Series(out)

        spread = df.where(F.col(vector).isNotNull()).withColumn("__x", F.explode(places(F.col(vector))))
        return spread.select(*df.columns, "__x.list", "__x.code")

    def nearest_lists(self, query: list[float], probes: int) -> list[int]:
        q = self._ready(np.asarray([query], dtype=np.float64), self.metric)[0]
        return np.argsort(((self.centres - q) ** 2).sum(1), kind="stable")[:probes].tolist()

    def search(self, query: list[float], k: int, probes: int = 4, where: Column | None = None, rerank: int | None = None) -> DataFrame:
        """The k nearest of the probed lists; with rerank, only that many by code are compared by their whole vectors."""
        return self.search_batch({0: query}, k, probes, where, rerank).drop("query", "rank")

    def search_batch(self, queries: dict[int, list[float]], k: int, probes: int = 4, where: Column | None = None, rerank: int | None = None) -> DataFrame:
        """query, key, distance and rank of the nearest k, each query in its nearest lists: one pass over these lists for all queries."""
        near = {n: self.nearest_lists(q, probes) for n, q in queries.items()}
        rows = self.rows.where(F.col("list").isin(sorted({x for own in near.values() for x in own})))
        rows = rows.where(where) if where is not None else rows
        if rerank is None:
            return batch_top_k(rows, self.key, self.vector, queries, k, self.metric, near)
        return batch_top_k(rows, self.key, self.vector, queries, k, self.metric, near, (self.centres, self.books, max(rerank, k)))


def ivf_chain(index: ClusterIndex, k: int, probes: int = 4) -> Chain:
    """Search by lists as a chain of steps: query, then the nearest."""
    return Chain().step("found", lambda queries: index.search_batch(_asked(queries), k, probes), ("queries",))


def rerank_chain(index: ClusterIndex, k: int, probes: int = 4, over: int = 4) -> Chain:
    """Search by codes, then by whole vectors among over * k."""
    return Chain().step("found", lambda queries: index.search_batch(_asked(queries), k, probes, rerank=over * k), ("queries",))


def hybrid_chain(index: ClusterIndex, texts: Callable[[], DataFrame], k: int, probes: int = 4) -> Chain:
    """The nearest vectors of one query and a ranked list of texts, fused."""
    chain = Chain().step("near", lambda queries: index.search_batch(_asked(queries), k, probes).select(index.key, "rank"), ("queries",))
    chain = chain.step("texts", texts)
    return chain.step("found", lambda near, ranked: fused([near, ranked], index.key).orderBy(F.desc("score"), index.key).limit(k), ("near", "texts"))


def _asked(queries: DataFrame) -> dict[int, list[float]]:
    """A stated set of queries (query, vector), which goes to all tasks."""
    return {r["query"]: list(r["vector"]) for r in queries.select("query", "vector").collect()}
