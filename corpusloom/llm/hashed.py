"""Linear models over hashed byte n-grams, fitted in Spark tasks on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.llm.common import let_go, trim

#: Hashed dimensions of each n-gram order, and the factor on relative frequencies.
BITS, SCALE = 15, 20.0
ORDERS = (2, 3)
WIDTH = len(ORDERS) << BITS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ngram_ids(flat: np.ndarray, fold: bool) -> list[np.ndarray]:
    """For each order, the feature of the n-gram that begins at each byte (as many as ``flat`` has n-grams)."""
    x = (LOWER[flat] if fold else flat).astype(np.uint32)
    out = []
    for k, n in enumerate(ORDERS):
        h = np.zeros(max(0, len(x) - n + 1), np.uint32)
        for i in range(n):
            h = (h * np.uint32(0x9E3779B1)) ^ (x[i : len(x) - n + 1 + i] * np.uint32(0x85EBCA6B))
        h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS))
    return out


def ngram_scores(flat: np.ndarray, offsets: np.ndarray, weights: np.ndarray, fold: bool) -> np.ndarray:
    """Each row's scaled mean weight of its n-grams (rows x models); ``weights``: features x models."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for ids, n in zip(ngram_ids(flat, fold), ORDERS, strict=True):
        start = np.minimum(offsets[:-1], len(ids))
        stop = np.clip(offsets[1:] - n + 1, start, len(ids))
        for m in range(weights.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(weights[:, m][ids], dtype=np.float64)])
            out[:, m] += SCALE * (total[stop] - total[start]) / np.maximum(stop - start, 1)
    return out


def ngram_features(text: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features and scaled relative frequencies of one text."""
    index, value = [], []
    for ids in ngram_ids(np.frombuffer(text, np.uint8), fold):
        at, n = np.unique(ids, return_counts=True)
        index.append(at)
        value.append(SCALE * n / max(1, len(ids)))
    return np.concatenate(index), np.concatenate(value)


def descend(index: pa.ListArray, value: pa.ListArray, rows: np.ndarray, y: np.ndarray, width: int, hinge: bool, epochs: int = 8, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the bias last) by stochastic gradient descent with averaging; ``y`` is the target in 0..1.

    ``rows`` are the numbers of the examples, in an order that does not depend on their places in the arrays; the
    arrays are read in place. Classes weigh alike, whatever their numbers.
    """
    begins, ids, values = index.offsets.to_numpy(), index.values.to_numpy(), value.values.to_numpy()
    skip = value.offsets.to_numpy() - begins  # the same for all, as both lists of an example are as long
    w, mean, n = np.zeros(width + 1), np.zeros(width + 1), 0
    share = max(1e-9, min(1 - 1e-9, float(y.mean())))
    order = np.random.default_rng(5)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for r in order.permutation(len(rows)):
            start, stop = begins[rows[r]], begins[rows[r] + 1]
            at, x = ids[start:stop], values[start + skip[0] : stop + skip[0]]
            margin = float(w[at] @ x) + w[-1]
            if hinge:
                sign = 1.0 if y[r] > 0.5 else -1.0
                pull = sign if sign * margin < 1 else 0.0
            else:
                pull = y[r] - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            pull *= step * 0.5 / (share if y[r] > 0.5 else 1 - share)
            if pull:
                w[at] += pull * x
                w[-1] += pull * 0.1
        w *= 1 - decay
        if epoch >= epochs // 2:
            mean += w
            n += 1
    return mean / max(1, n)


def fit(rows: DataFrame, width: int, hinge: bool) -> dict[str, np.ndarray]:
    """A linear model for each ``model`` of ``rows`` (model, y, index, value), each fitted in a task of its own.

    ``index`` and ``value`` are lists of int and float. The caller bounds the rows of a model. Only the weights come
    to the driver.
    """

    def train(group: pa.Table) -> pa.Table:
        # flat arrays of 8 bytes a feature, no objects of Python
        order = pc.sort_indices(group, sort_keys=[("key", "ascending")]).to_numpy()
        index, value = (group[c].combine_chunks() for c in ("index", "value"))
        w = descend(index, value, order, group["y"].to_numpy()[order], width, hinge).astype(np.float32)
        return pa.table({"model": group["model"].slice(0, 1), "w": pa.array([w.tobytes()], pa.binary())})

    found = rows.groupBy("model").applyInArrow(train, "model string, w binary").collect()
    return {r["model"]: np.frombuffer(bytes(r["w"]), np.float32) for r in found}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()
