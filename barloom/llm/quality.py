"""Quality classifier: random Fourier features of document statistics, ridge by
partition-summed normal equations, isotonic calibration.

Statistics of a whole text are standardised and mapped to cosines at random
frequencies (a Gaussian kernel); tasks sum phi phi' and phi y over a bounded
sample of labelled rows, by fold; the sums over all folds give the weights. For
the calibration by pool-adjacent-violators, each row of the sample is scored
with the sums of the other folds, so no row calibrates what was fitted on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, find_words, fold, range_hash, read
from .linear import labelled

#: Labelled rows of the fit, about; folds; features; kernel width; ridge.
SAMPLE_ROWS = 16384
FOLDS = 4
FEATURES = 256
WIDTH = 2.5
RIDGE = 1.0
SEED = 7

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation, 6 symbol, 7 beyond ASCII
for _i in range(128):
    _c = chr(_i)
    _KIND[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c in ".,;:'\"()-" else 6 if _c.isprintable() else 0
_KIND[128:] = 7
NAMES = ("log_words", "mean_word", "sd_word", "lower", "upper", "digit", "punct", "symbol", "beyond", "space", "lines", "distinct", "same_as_last", "symbol_end", "upper_words", "digit_words", "single", "stop_ratio", "longest", "first_upper")


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text of a slice; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(buf):
        return out
    start, end, first = find_words(buf, off)
    kind = _KIND[buf]
    size = np.maximum(np.diff(off), 1)
    row = np.repeat(np.arange(n), np.diff(off))
    by = np.bincount(row * 8 + kind, minlength=n * 8).reshape(n, 8) / size[:, None]
    lines = np.bincount(row[buf == 10], minlength=n)
    words = np.diff(first)
    many = np.maximum(words, 1)
    own = np.repeat(np.arange(n), words)
    length = (end - start).astype(float)
    mean = np.bincount(own, length, minlength=n) / many
    square = np.bincount(own, length * length, minlength=n) / many
    word = range_hash(buf, start, end) if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((word, own))
    new = np.ones(len(word), bool)
    if len(word) > 1:
        new[1:] = (word[order][1:] != word[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][new], minlength=n)
    again = np.flatnonzero((word[1:] == word[:-1]) & (own[1:] == own[:-1])) if len(word) > 1 else np.zeros(0, int)
    runs = np.diff(np.r_[np.flatnonzero(new), len(word)])
    top = np.zeros(n)
    np.maximum.at(top, own[order][new], runs)
    ends = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    heads = kind[start] if len(start) else np.zeros(0, np.uint8)
    tail = kind[np.maximum(end - 2, start)] if len(end) else np.zeros(0, np.uint8)
    count = lambda mask: np.bincount(own[mask], minlength=n) / many
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    out[:] = np.stack([
        np.log1p(words), np.minimum(mean, 40), np.sqrt(np.maximum(square - mean * mean, 0)).clip(max=40), by[:, 1], by[:, 2], by[:, 3], by[:, 5], by[:, 6], by[:, 7], by[:, 4],
        np.log1p(lines) - np.log1p(words), distinct / np.sqrt(many), np.bincount(own[again], minlength=n) / many, count(ends == 6), count((heads == 2) & (tail == 2) & (length > 1)),
        count(heads == 3), count(length == 1), top / many, np.log1p(longest), count(heads == 2),
    ], axis=1)
    return out


def frequencies(features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(NAMES), features)) / WIDTH, rng.uniform(0, 2 * np.pi, features)


def mapped(x: np.ndarray, middle: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features, with a constant and the statistics themselves."""
    z = np.clip((x - middle) / scale, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase)])


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (score, calibrated value) at the ends of the
    pooled blocks, for linear interpolation. Each block is shrunk by half a row
    to either side, so no value is 0 or 1 for sure."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest score, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    v = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in range(2)]))
    return x, v


def sums(rows: DataFrame, part, width: int) -> np.ndarray:
    """Sum over tasks of part(statistics, labels), `width` numbers for each fold."""

    def run(batches):
        total = np.zeros((FOLDS, width))
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            own = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in chunks(batch.column(0)):
                x = statistics(buf, off)
                for k in range(FOLDS):
                    mine = own[lo:hi] == k
                    total[k] += part(x[mine], label[lo:hi][mine]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    parts = rows.mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(p.total).reshape(FOLDS, width) for p in parts), np.zeros((FOLDS, width)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS):
    """Everything a score needs: scales, frequencies, weights, calibration. The
    driver gets each task's sums, of fixed size, and the sample's raw scores."""
    rows = labelled(docs, labels, "quality", 3, 1, bound)
    rows = rows.select("text", "label", F.pmod(F.xxhash64("key", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("part"))
    k = len(NAMES)
    moments = sums(rows, lambda x, y: np.vstack([np.full(k, len(x)), x.sum(axis=0), (x * x).sum(axis=0), np.full(k, y.sum())]), 4 * k).sum(axis=0).reshape(4, k)
    n = moments[0, 0]
    omega, phase = frequencies(FEATURES, SEED)
    if n == 0 or moments[3, 0] in (0, n):
        value = 0.5 if n == 0 else float(moments[3, 0] > 0)
        return np.zeros(k), np.ones(k), omega, phase, np.zeros(1 + k + FEATURES), np.zeros(1), np.array([value])
    middle = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - middle * middle, 0)) + 1e-3
    width = 1 + k + FEATURES

    def equations(x, y):
        phi = mapped(x, middle, scale, omega, phase)
        return np.vstack([phi.T @ phi, phi.T @ y])

    each = sums(rows, equations, (width + 1) * width).reshape(FOLDS, width + 1, width)
    total = each.sum(axis=0)
    weights, *others = [np.linalg.solve(m[:width] + RIDGE * np.eye(width), m[width]) for m in (total, *(total - x for x in each))]
    others = np.stack(others)

    def raw(batches):
        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in chunks(batch.column(0)):
                score = (mapped(statistics(buf, off), middle, scale, omega, phase) * others[own[lo:hi]]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(1).slice(lo, hi - lo)], names=["score", "label"])

    scored = rows.mapInArrow(raw, "score double, label int").toArrow()
    at, value = isotonic(scored.column("score").to_numpy(), scored.column("label").to_numpy().astype(float))
    return middle, scale, omega, phase, weights, at, value


def quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Only text is an input of a score. Null and empty texts have zeros for
    statistics and are scored from them. Labels that are null or neither 0 nor 1
    are left out; with labels of one class only, that class is the score of all
    (0.5 without any). Repeated rows give repeated results; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound))

    def run(batches):
        middle, scale, omega, phase, weights, at, value = shared.value
        for batch in batches:
            score = np.zeros(len(batch))
            for lo, hi, buf, off in chunks(batch.column(1)):
                score[lo:hi] = np.interp(mapped(statistics(buf, off), middle, scale, omega, phase) @ weights, at, value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold("doc_id", 3) == 1).alias("held_out"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3(spark, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
