"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text in one pass over its bytes and words. Trees grow by histograms of quantile bins with
logistic loss on a bounded sample of labelled documents; afterwards all trees lie flattened in a few arrays, and a batch of
documents goes through all of them at once in numpy. The model (some kilobytes) goes along with the tasks; scoring has no shuffle.

Defined cases: a null text is an empty text; an empty text has statistics of zeros and is scored; without any labelled
document, or with one class only, every score is the share of that class (0.5 without labels); repeated documents are each
scored, all alike; a text of any length is measured whole; equal gains of splits go to the first statistic and limit; doc_id is
only used to tell the held-out fold; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, hands_back, small_batches
from .training import SAMPLE, labelled_sample

FOLDS = 5
THRESHOLD = 0.3
TREES = 60
LEAVES_DEPTH = 4
RATE = 0.2
BINS = 64
SMOOTH = 1.0
MIN_LEAF = 20

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
BLANK = b" \t\n\x0b\x0c\r"
BEYOND = bytes(range(128, 256))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
STATISTICS = ("log_bytes", "log_words", "mean_word", "upper", "lower", "digits", "marks", "beyond", "exclamations", "symbols", "bars", "distinct", "top_word", "top_five", "same_next", "log_lines", "line_words", "repeated_lines", "sentence_ends", "short_words", "long_words", "bare_words", "marked_words", "repeated_pairs", "entropy")


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n, m = len(data), len(words)
    if not m:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    left = lambda drop: n - len(data.translate(None, drop))
    dense = n - left(BLANK)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    lines = [x for x in map(bytes.strip, data.split(b"\n")) if x]
    sizes = list(map(len, words))
    letters = len(data.translate(None, MARKS + BLANK + DIGITS))
    ends = sum(map(data.count, (b". ", b"! ", b"? ", b".\n", b"!\n", b"?\n"))) + (data.rstrip()[-1:] in (b".", b"!", b"?"))
    frequency = np.fromiter(counts.values(), dtype=float) / m
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(np.log1p(m)), dense / m, left(UPPER) / dense, left(LOWER) / dense, left(DIGITS) / dense, left(MARKS) / dense, left(BEYOND) / dense, data.count(b"!") / m, left(b"#*$%&|<>") / m, data.count(b"|") / m,
        len(counts) / m, top[0] / m, sum(top) / m, sum(map(bytes.__eq__, words, words[1:])) / m, float(np.log1p(len(lines))), m / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), ends / m,
        sum(s <= 2 for s in sizes) / m, sum(s >= 15 for s in sizes) / m, sum(not w.strip(MARKS) for w in counts) / m, letters / dense, 1 - pairs / max(1, m - 1), float(-(frequency * np.log(frequency)).sum() / np.log(m + 1)),
    ]


class Boosted:
    """Boosted trees, flattened: node k of all trees has feature, limit and children; a leaf is its own child and has a value."""

    def __init__(self, start: float):
        self.start, self.roots = start, np.zeros(0, dtype=np.int32)
        self.feature, self.left, self.right = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.limit, self.value = np.zeros(0), np.zeros(0)

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray) -> Boosted:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            return cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        model = cls(float(np.log(y.mean() / (1 - y.mean()))))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        margin, nodes, roots = np.full(len(y), model.start), [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            margin += cls._grow(binned, cuts, y - p, p * (1 - p), nodes)
        model.roots = np.array(roots, dtype=np.int32)
        table = np.array(nodes)
        model.feature, model.left, model.right = (table[:, k].astype(np.int32) for k in (0, 2, 3))
        model.limit, model.value = table[:, 1], table[:, 4]
        return model

    @staticmethod
    def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, nodes: list) -> np.ndarray:
        """Adds one tree to nodes, level by level; returns its step for every row."""
        step = np.zeros(len(gradient))
        level = [(len(nodes), np.arange(len(gradient)))]
        nodes.append(None)
        for depth in range(LEAVES_DEPTH + 1):
            below = []
            for me, rows in level:
                g, h = gradient[rows], weight[rows]
                value = RATE * g.sum() / (h.sum() + SMOOTH)
                best = Boosted._split(binned[rows], g, h, len(cuts)) if depth < LEAVES_DEPTH and len(rows) >= 2 * MIN_LEAF else None
                if best is None:
                    nodes[me] = (0, np.inf, me, me, value)
                    step[rows] = value
                    continue
                feature, limit = best
                low = binned[rows, feature] <= limit
                nodes[me] = (feature, cuts[feature][limit], len(nodes), len(nodes) + 1, 0.0)
                below += [(len(nodes), rows[low]), (len(nodes) + 1, rows[~low])]
                nodes += [None, None]
            level = below
        return step

    @staticmethod
    def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, features: int) -> tuple[int, int] | None:
        best, most = None, 1e-6
        whole = g.sum() ** 2 / (h.sum() + SMOOTH)
        for f in range(features):
            own = binned[:, f]
            gs, hs, ns = (np.cumsum(np.bincount(own, w, minlength=BINS)) for w in (g, h, np.ones(len(g))))
            gain = gs**2 / (hs + SMOOTH) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + SMOOTH) - whole
            gain[(ns < MIN_LEAF) | (ns[-1] - ns < MIN_LEAF)] = 0
            k = int(np.argmax(gain))
            if gain[k] > most:
                best, most = (f, k), float(gain[k])
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row: all trees at once, one step down a turn."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(LEAVES_DEPTH if len(self.roots) else 0):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


@hands_back
def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"label": batch.label, "x": [statistics(t) for t in batch.text]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees from a bounded sample of labelled documents outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", doc_remainder(FOLDS) != 0, sample).select("label", "text").mapInPandas(_measure, "label int, x array<double>")
    found = rows.toPandas().sort_values("label", kind="stable")
    order = np.lexsort(np.array(found.x.tolist()).T) if len(found) else []  # a fixed order, whatever the tasks' order
    found = found.iloc[order]
    return Boosted.train(np.array(found.x.tolist(), dtype=float).reshape(-1, len(STATISTICS)), found.label.to_numpy(dtype=float))


def scores(docs: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    @hands_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.text], dtype=float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": batch.doc_id.map(lambda v: None if v is None else int(v)).astype("Int64"), "score": model.score(x) if len(batch) else []})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(doc_remainder(FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return scores(docs, fit(docs, labels))
