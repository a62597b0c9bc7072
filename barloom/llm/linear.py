"""Fits of small linear models on bounded samples, and the samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, doc_key, fold


def sample(rows: DataFrame, bound: int, seed: str) -> DataFrame:
    """About `bound` rows of rows(key, ...), chosen by a hash of key, or all if
    there are no more. Reruns choose the same rows."""
    there = rows.count()
    if there <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(bound / there * (1 << 30)))


#: Partitions of a sample.
TASKS = 8


def labelled(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, bound: int) -> DataFrame:
    """(key, text, label): a sample of about `bound` documents with a non-null
    label 0 or 1 outside the held-out fold. Of several labels for one document
    the largest counts. The sampled ids are broadcast; their number is `bound`. The
    sample is written once, for all the passes of a fit."""
    own = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
    own = own.groupBy(doc_key().alias("key")).agg(F.max(F.col(column)).cast("int").alias("label"))
    own = sample(own, bound, column).select(F.col("key").alias("label_key"), "label")
    texts = docs.select(doc_key().alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    return checkpoint(texts.join(F.broadcast(own), F.col("key") == F.col("label_key")).select("key", "text", "label").repartition(TASKS))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float = 1e-3, steps: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression on sparse rows
    (row, column, value) with row weights, by accelerated gradient steps."""
    n = max(len(y), 1)
    each = np.ones(len(y)) / n if weight is None else weight / max(weight.sum(), 1e-9)

    def times(w):
        return np.bincount(rows, values * w[columns], minlength=len(y))

    def back(g):
        return np.bincount(columns, values * g[rows], minlength=width)

    v = np.ones(width) / max(width, 1) ** 0.5
    top = 1.0
    for _ in range(12):  # largest curvature, by power steps
        u = back(times(v) * each)
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    rate = 1 / (0.25 * (top * 1.2 + 1) + ridge)
    w, b, pw, pb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for k in range(steps):
        m = k / (k + 3)
        zw, zb = w + m * (w - pw), b + m * (b - pb)
        g = (1 / (1 + np.exp(-np.clip(times(zw) + zb, -35, 35))) - y) * each
        pw, pb = w, b
        w, b = zw - rate * (back(g) + ridge * zw), zb - rate * float(g.sum())
    return w, b
