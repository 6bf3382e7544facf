"""Toxic passages as maximum-scoring segments of a document's words.

Token scores are log-odds between toxic and other documents with Dirichlet priors: PRIOR documents, divided as the labels of the
sample are, stand beside those that hold the token. A token is a word or, as a word may be inflected or built anew, the
beginning of a word. Tokens count once a document, near copies (by their smallest shingle hash) once a label, and only those
go into the table whose likelihood ratio is significant over all tokens. A word has the score of its longest beginning in the
table; all other words have a small negative score. A linear-time scan (Ruzzo and Tompa) finds every maximal segment of a text. The scores of segments in
documents without the label follow an extreme-value law, E = K n exp(-lambda s), whose parameters are taken from the sample; a
document's evidence is the sum of -ln E over its significant segments, and a logistic curve turns it into a probability.

Tokens are counted in tasks before they are summed. Significance decides what goes into the table; TOKENS bounds it for the
broadcast, the most significant first (a sample of SAMPLE documents had far fewer significant tokens on all tables tried, see
README). The curve is fitted on the evidence of a bounded sample of labelled documents: two numbers each. Scoring has no shuffle.

Defined cases: a null text is an empty text; texts without words have no segment and the curve's lowest score; without any
labelled document, or with one class only, every score is the share of that class (0 without labels); repeated documents are
each scored; a text of any length is scanned whole; equally significant tokens are ordered by name; doc_id is only used to tell
the held-out fold; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_remainder, hands_back, materialise, small_batches
from .cpsjoin import SHINGLE, WordHashes, shingles
from .training import SAMPLE, labelled_sample

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
BEGINNINGS = (7, 6, 5, 4, 3)
#: Most tokens of the table, by significance (signed root of the likelihood ratio), and least documents and significance.
TOKENS = 50_000
MIN_DOCS = 4
MIN_ROOT = 4.5
#: Weight of the prior, in documents.
PRIOR = 4.0
#: Score of a word that the table lacks.
DRIFT = -0.15
CACHE = 500_000
SIGNIFICANT = 0.05
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def tokens_of(word: str) -> list[str]:
    """The word, then its beginnings (marked by a star), longest first."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


class Scores(dict):
    """Scores of words, by their longest token in the table; begins anew when it holds too many."""

    def __init__(self, table: dict[str, float]):
        self.table = table
        super().__init__()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = next((self.table[t] for t in tokens_of(word) if t in self.table), DRIFT)
        self[word] = value
        return value


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) in linear time; each positive score stands in exactly one."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    starts: list[int] = []
    stops: list[int] = []
    link: list[int] = []  # the nearest earlier candidate with a smaller sum before it
    for at in np.flatnonzero(scores > 0).tolist():
        start, stop = at, at + 1
        while True:
            k = len(starts) - 1
            while k >= 0 and sums[starts[k]] >= sums[start]:
                k = link[k]
            if k < 0 or sums[stops[k]] >= sums[stop]:
                starts.append(start)
                stops.append(stop)
                link.append(k)
                break
            start = starts[k]
            del starts[k:], stops[k:], link[k:]
    return [(a, b, float(sums[b] - sums[a])) for a, b in zip(starts, stops, strict=True)]


@dataclass
class Model:
    table: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    rate: float = 1e-3  # K
    base: float = -20.0
    slope: float = 1.0

    def surprise(self, score: float, words: int) -> float:
        """-ln E of a segment."""
        return self.scale * score - np.log(self.rate * max(words, 1))

    def evidence(self, found: list[tuple[int, int, float]], words: int) -> float:
        return float(sum(x for x in (self.surprise(s, words) for _, _, s in found) if x > 0))

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + self.slope * np.log1p(evidence))))


@hands_back
def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.label, batch.text, strict=True):
            found[label].update({t for w in set(words_of(text)) for t in tokens_of(w)})
    for label, counts in enumerate(found):
        if counts:
            yield pd.DataFrame({"token": list(counts), "label": label, "n": list(counts.values())})


@hands_back
def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingles((t or "").encode(), SHINGLE, hashes) for t in batch.text]
        yield batch.assign(key=[int(x[0].astype(np.int64)) if len(x) else 0 for x in found])


def token_table(sample: DataFrame, size: int = TOKENS) -> dict[str, float]:
    """Scores of the most significant tokens, at most size."""
    sample = sample.select("label", "text").mapInPandas(_keys, "label int, text string, key long").dropDuplicates(["label", "key"]).cache()
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        sample.unpersist()
        return {}
    counts = sample.mapInPandas(_count, "token string, label int, n long").groupBy("token").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"))
    share, total = n1 / (n0 + n1), F.col("y0") + F.col("y1")
    part = lambda y, p: F.when(y > 0, y * F.log(y / (total * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("y1"), share) + part(F.col("y0"), 1 - share))
    chance = (F.col("y1") + PRIOR * share) / (total + PRIOR)
    scored = counts.where(total >= MIN_DOCS).where(chance > share).select("token", F.sqrt(F.greatest(ratio, F.lit(0.0))).alias("root"), (F.log(chance / (1 - chance)) - float(np.log(share / (1 - share)))).alias("odds"))
    rows = scored.where(F.col("root") >= MIN_ROOT).orderBy(F.desc("root"), "token").limit(size).collect()
    sample.unpersist()
    return {r["token"]: r["odds"] for r in rows}


def _scan(held):
    @hands_back
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(held.value)
        for batch in batches:
            out = []
            for text in batch.text:
                words = words_of(text)
                out.append((len(words), [s for _, _, s in segments(np.fromiter(map(scores.__getitem__, words), dtype=float, count=len(words)))]))
            yield pd.DataFrame({"label": batch.label, "n": [n for n, _ in out], "found": [f for _, f in out]})

    return scan


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Token table, extreme-value law and curve, from a bounded sample of labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", doc_remainder(FOLDS) != HELD_OUT, size).select("label", "text").dropDuplicates()
    table = token_table(sample)
    held = docs.sparkSession.sparkContext.broadcast(table)
    rows = materialise(sample.mapInPandas(_scan(held), "label int, n long, found array<double>"), "segments")
    model, n, positive = Model(table), *rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, n):
        share = positive / n if n else 0.0
        return Model({}, base=float(np.log((share + 1e-6) / (1 - share + 1e-6))), slope=0.0)
    plain = rows.where("label = 0")
    scores = plain.select(F.explode("found").alias("s"))
    least, many = scores.agg(F.percentile("s", 0.5), F.count("*")).first()
    if many >= 10:
        tail, mean = scores.where(F.col("s") >= least).agg(F.count("*"), F.avg(F.col("s") - least)).first()
        model.scale = 1 / max(mean, 1e-2)
        model.rate = (tail + 1) * float(np.exp(min(model.scale * least, 50))) / max(plain.agg(F.sum("n")).first()[0], 1)
    surprise = lambda s: model.scale * s - F.log(model.rate * F.greatest("n", F.lit(1)))
    evidence = F.aggregate(F.transform("found", lambda s: F.greatest(surprise(s), F.lit(0.0))), F.lit(0.0), lambda t, s: t + s)
    points = rows.select("label", evidence.alias("evidence")).orderBy("evidence", "label").toPandas()
    discard(rows)
    model.base, model.slope = _curve(np.log1p(points.evidence.to_numpy(dtype=float)), points.label.to_numpy(dtype=float))
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's method, with a light pull to zero."""
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ w)))
        slope = design.T @ (y - p) - 0.01 * w
        bend = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


PASSAGES = "doc_id long, score double, passages array<struct<start:long,stop:long,score:double,surprise:double>>"


def passages(docs: DataFrame, model: Model, significant: float = SIGNIFICANT) -> DataFrame:
    """doc_id, score and the significant passages (word offsets; surprise is -ln E) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    @hands_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(**held.value)
        scores = Scores(model.table)
        for batch in batches:
            evidence, found = [], []
            for text in batch.text:
                words = words_of(text)
                own = segments(np.fromiter(map(scores.__getitem__, words), dtype=float, count=len(words)))
                evidence.append(model.evidence(own, len(words)))
                marked = ((a, b, s, float(model.surprise(s, len(words)))) for a, b, s in own)
                found.append([{"start": a, "stop": b, "score": s, "surprise": x} for a, b, s, x in marked if x >= -np.log(significant)])
            yield pd.DataFrame({"doc_id": batch.doc_id.map(lambda v: None if v is None else int(v)).astype("Int64"), "score": model.chance(np.array(evidence)), "passages": found})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, PASSAGES)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and passages of every document."""
    small_batches(docs.sparkSession)
    found = passages(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(doc_remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")
