"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a vector of counts and ratios, every entry of which is spread
over the quantile bins of the training rows: all labelled rows outside the
held-out fold.  Weights are learned from all preference pairs (a row labelled 1
is preferred to a row labelled 0) by the logistic loss on the difference of the
two vectors.  A pair's loss depends on two scores alone, so a pass counts the
scores of either class on a grid of CELLS cells (between two cells by share) and
the pairs are those of the cells.  The cut is a quantile of the training scores,
the share of rows labelled 0; a score is moved so that this cut lands on
THRESHOLD.

Edge cases: null and empty texts have a vector of their own and a score; with
labels of one class only (or none) every score is the share of ones (0.5
without labels); repeated rows and null keys are scored row by row; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .labelled import SCALE, Rows, minimise, order_statistics, quantiles, sigmoid, training_rows, whole

THRESHOLD = 0.3
BINS = 10
N_FEATURES = 27
CELLS = 4096
SHRINK = 1e-5
#: Two or more signs at the end of a token; a run of signs is read once, whatever follows it.
_EDGE = re.compile(r"(?<![^\w\s])[^\w\s]{2,}+(?=\s|$)")


def features(text: str | None) -> list[float]:
    """Counts and ratios of a whole text."""
    text = text or ""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * N_FEATURES
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    letters = sum(map(str.isalpha, map("".join, counts)))
    chars = Counter(text)
    upper = sum(c for ch, c in chars.items() if ch.isupper())
    alpha = sum(c for ch, c in chars.items() if ch.isalpha())
    digit = sum(c for ch, c in chars.items() if ch.isdigit())
    symbol = sum(c for ch, c in chars.items() if not ch.isalnum() and not ch.isspace() and ch not in ".,;:!?'\"-()")
    ends = sum(chars.get(ch, 0) for ch in ".!?")
    entropy = -sum(c / k * math.log2(c / k) for c in counts.values())
    char_entropy = -sum(c / n * math.log2(c / n) for c in chars.values())
    same = sum(a == b for a, b in pairwise(words))
    bigrams = Counter(pairwise(words))
    repeated = sum(c for c in bigrams.values() if c > 1)
    return [
        math.log1p(k), math.log1p(n), n / k, len(counts) / k, top[0][1] / k, sum(c for _, c in top) / k,
        len(lines) / k, len(line_counts) / max(1, len(lines)), line_counts.most_common(1)[0][1] / max(1, len(lines)) if lines else 0.0,
        letters / len(counts), upper / n, alpha / n, digit / n, symbol / n, ends / k, entropy, entropy / max(1.0, math.log2(k)), char_entropy,
        same / k, repeated / k, text.count("|") / k, len(_EDGE.findall(text)) / k, max(map(len, counts)), chars.get(",", 0) / k,
        sum(c for w, c in counts.items() if len(w) <= 3) / k, sum(c for w, c in counts.items() if len(w) >= 12) / k, sum(w[:1].isupper() for w in words) / k,
    ]


class Model:
    """Bin edges, weights and the place of the cut: a few kilobytes, whatever the corpus."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray, cut: float, scale: float, base: float | None = None):
        self.edges, self.weights, self.cut, self.scale, self.base = edges, weights, cut, scale, base

    def design(self, x: np.ndarray) -> np.ndarray:
        """One-hot bins of every feature, as column indexes."""
        width = self.edges.shape[1] + 1
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="right") + j * width for j in range(x.shape[1])], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.design(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return sigmoid(self.scale * (self.raw(x) - self.cut) + math.log(THRESHOLD / (1 - THRESHOLD)))


def _least(rows: Rows, values: Callable[..., np.ndarray], above: float) -> float | None:
    """The least value over ``above``; each of eight passes fixes eight bits of its rank's prefix."""
    n, over = rows.sums(lambda *block: np.array([len(v := values(*block)), (v > above).sum()]), 2)
    return float(order_statistics(rows, lambda *block: [values(*block)], [np.array([n - over])])[0][0]) if over else None


def learn(rows: Rows) -> Model:
    """The model of all rows, whose blocks are (y, vectors)."""
    bad, good = map(int, rows.sums(lambda y, x: np.bincount(y, minlength=2), 2))
    n = good + bad
    shares = np.arange(1, BINS) / BINS
    edges = np.array(quantiles(rows, lambda y, x: list(x.T), [n] * N_FEATURES, [shares] * N_FEATURES)) if n else np.zeros((N_FEATURES, BINS - 1))
    size = N_FEATURES * BINS
    model = Model(edges, np.zeros(size), 0.0, 1.0)
    if not good or not bad:
        model.base = good / n if n else 0.5
        return model
    design = model.design

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        by = w.reshape(N_FEATURES, BINS)
        low, high = by.min(axis=1).sum() - 1e-6, by.max(axis=1).sum() + 1e-6
        step = (high - low) / (CELLS - 1)

        def spots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = design(x)
            at = (w[d].sum(axis=1) - low) / step
            cell = np.clip(at.astype(np.int64), 0, CELLS - 2)
            return d, cell, at - cell

        def counts(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            _, cell, share = spots(x)
            share, own = whole(share), y * CELLS + cell
            return (np.bincount(own, SCALE - share, 2 * CELLS) + np.bincount(own + 1, share, 2 * CELLS)).astype(np.int64)

        zeros, ones = rows.sums(counts, 2 * CELLS).reshape(2, CELLS) / SCALE
        zeros, ones = zeros / bad, ones / good
        gap = np.arange(1 - CELLS, CELLS) * step  # of a row labelled 0 over a row labelled 1
        # Means over the other class, at every cell: of the loss, and of its slope by the difference.
        loss = ones @ np.convolve(zeros, np.logaddexp(0, gap)[::-1], "valid")
        slope = np.stack([np.convolve(ones, sigmoid(gap), "valid"), -np.convolve(zeros, sigmoid(gap)[::-1], "valid")])

        def gradient(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            d, cell, share = spots(x)
            pull = whole(slope[y, cell] * (1 - share) + slope[y, cell + 1] * share)
            return np.bincount((d + y[:, None] * size).ravel(), np.repeat(pull, N_FEATURES), 2 * size).astype(np.int64)

        g0, g1 = rows.sums(gradient, 2 * size).reshape(2, size) / SCALE
        return float(loss + SHRINK / 2 * (w @ w)), g0 / bad + g1 / good + SHRINK * w

    model.weights = minimise(evaluate, model.weights)
    raw = lambda y, x: model.raw(x)
    half = np.array([0.5])
    (cut,), (low,), (high,) = quantiles(rows, lambda y, x: [s := raw(y, x), s[y == 0], s[y == 1]], [n, bad, good], [np.array([bad / n]), half, half])
    # The cut is that quantile, moved to the middle of the gap above it, if there is one.
    above = _least(rows, raw, cut)
    model.cut = float(cut if above is None else (cut + above) / 2)
    model.scale = 6.0 / max(1e-9, high - low)
    return model


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """``learn`` from vectors that are at hand."""
    return learn(Rows(None, [(np.asarray(y, np.int64), np.asarray(x, float))]))


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)


def with_vectors(rows: DataFrame) -> DataFrame:
    """(id, text) with the bytes of its vector in place of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in matrix(batch.column(1).to_pylist())], pa.binary())], ["id", "text"])

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text binary")


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The block of a batch (bytes of a vector, y)."""
    x = np.frombuffer(b"".join(batch.column(0).to_pylist()), float).reshape(-1, N_FEATURES)
    return batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), x


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, key: str = "doc_id", text: str = "text", local_rows: int | None = None) -> Model:
    """Learns from every labelled row outside the held-out fold and all preference pairs of them; vectors cross the shuffle, no texts."""
    rows = Rows.of(training_rows(docs, labels, label, modulus, remainder, key, text, with_vectors), vectors, "quality", local_rows)
    model = learn(rows)
    rows.drop()
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(matrix(batch.column(1).to_pylist())))], ["_key", "score"])

    return map_arrow(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), run, f"_key {kind}, score double").withColumnRenamed("_key", key)
