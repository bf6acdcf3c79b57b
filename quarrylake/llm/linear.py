"""Multi-label logistic regression over dense and hashed features, in numpy.

Used for models fitted on a bounded sample of rows; scoring runs in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Rows:
    """Dense features and, for each row, hashed feature numbers."""

    dense: np.ndarray
    counts: np.ndarray
    index: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    def take(self, at: np.ndarray) -> Rows:
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return Rows(self.dense[at], counts, self.index[np.repeat(starts[at] - (ends - counts), counts) + np.arange(total)])

    def with_dense(self, more: np.ndarray) -> Rows:
        return Rows(np.hstack([self.dense, more]), self.counts, self.index)


@dataclass
class Linear:
    dense: np.ndarray
    hashed: np.ndarray
    bias: np.ndarray
    flat: bool = False  # hashed features count fully, not by the root of their number

    def scale(self, counts: np.ndarray) -> np.ndarray:
        return np.full(len(counts), 0.3) if self.flat else 1.0 / np.sqrt(np.maximum(counts, 1))

    def logits(self, x: Rows) -> np.ndarray:
        out = x.dense @ self.dense + self.bias
        if len(x.index):
            row = np.repeat(np.arange(len(x)), x.counts)
            scale = self.scale(x.counts)
            for k in range(out.shape[1]):
                out[:, k] += scale * np.bincount(row, self.hashed[x.index, k], minlength=len(x))
        return out

    def probabilities(self, x: Rows) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(x: Rows, y: np.ndarray, width: int, weight: np.ndarray | None = None, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, batch: int = 256, seed: int = 7, flat: bool = False) -> Linear:
    """Adaptive-gradient logistic regression; y is rows x labels of 0 and 1."""
    n, labels = y.shape
    weight = np.ones(n) if weight is None else weight
    m = Linear(np.zeros((x.dense.shape[1], labels)), np.zeros((width, labels)), np.zeros(labels), flat)
    g_dense, g_hashed, g_bias = np.full_like(m.dense, 1e-3), np.full_like(m.hashed, 1e-3), np.full_like(m.bias, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            at = order[start : start + batch]
            b = x.take(at)
            error = (m.probabilities(b) - y[at]) * weight[at, None] / len(at)
            d = b.dense.T @ error + decay * m.dense
            g_dense += d * d
            m.dense -= rate * d / np.sqrt(g_dense)
            e = error.sum(axis=0)
            g_bias += e * e
            m.bias -= rate * e / np.sqrt(g_bias)
            if len(b.index):
                row = np.repeat(np.arange(len(b)), b.counts)
                scale = np.repeat(m.scale(b.counts), b.counts)
                used, place = np.unique(b.index, return_inverse=True)
                for k in range(labels):
                    g = np.bincount(place, error[row, k] * scale, minlength=len(used)) + decay * m.hashed[used, k]
                    g_hashed[used, k] += g * g
                    m.hashed[used, k] -= rate * g / np.sqrt(g_hashed[used, k])
    return m


def calibrated(p: np.ndarray, y: np.ndarray, floor: float = 0.5) -> np.ndarray:
    """For each label the threshold of best F1 on held-out rows, at least ``floor``."""
    out = np.full(p.shape[1], floor)
    for k in range(p.shape[1]):
        order = np.argsort(-p[:, k])
        hit = np.cumsum(y[order, k])
        f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, y[:, k].sum()))
        # of the thresholds that are as good as the best, the lowest
        last = int(np.flatnonzero(f1 >= f1.max() - 0.002)[-1])
        below = p[order[last + 1], k] if last + 1 < len(order) else 0.0
        out[k] = max(floor, (p[order[last], k] + below) / 2)
    return out


def bounded_sample(df: DataFrame, key: str, rows: int) -> list:
    """About ``rows`` rows chosen by a 64-bit hash of the key, for fitting only; the
    same rows whatever the partitions, and as many at any size of the table. Rows
    that repeat one key are chosen or left out together, so no more than 1.5 times
    ``rows`` are taken, those of the smallest hashes."""
    share = min(1.0, rows / max(1, df.count()))
    span = 1 << 62
    place = F.xxhash64(key).bitwiseAND(F.lit(span - 1))
    chosen = df.select("*", place.alias("_place")).where(F.col("_place") < int(share * span))
    return sorted(chosen.orderBy("_place", *df.columns).limit(int(1.5 * rows)).drop("_place").collect(), key=lambda r: tuple((x is not None, x) for x in r))
