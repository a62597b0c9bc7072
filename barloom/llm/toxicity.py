"""Toxicity: linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (4, 6 and 8 bytes of the lower-cased text,
anything but letters as space) is counted by class over a bounded sample of
labelled rows; each feature is scaled by its log-count ratio r, and a logistic
regression is fitted on the scaled features with the strongest ratios, the rarer
class weighed up. Settings were chosen by folds of the training rows. Scoring
looks up w * r in one table of fixed size, for every n-gram of every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import chunks, fold, read, whole_row
from .linear import labelled, logistic

#: Labelled rows that the fit uses, about; the table's bits; features kept.
SAMPLE_ROWS = 8192
TABLE_BITS = 20
KEPT = 4096
SIZES = (4, 6, 8)
#: Ridge of the regression; a rarer class weighs more by this power of the ratio.
RIDGE, RARE = 1e-4, 2 / 3

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def ngrams(buf: np.ndarray, off: np.ndarray, sizes=SIZES, bits: int = TABLE_BITS):
    """(row, slot) of each n-gram of each size in the texts of one slice."""
    letters = _FOLD[buf]
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    total, at = np.zeros(len(buf), np.uint32), 0
    for k in range(max(sizes)):
        n = len(buf) - k
        if n <= 0:
            return
        total = total[:n] * np.uint32(0x01000193) + letters[k:]
        at = k + 1
        if at in sizes:
            whole = row[:n] == row[k:]
            slot = (total * np.uint32(0x9E3779B1) ^ np.uint32(at * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)
            yield row[:n], slot, whole


def present(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None):
    """Distinct (row, slot) pairs, those of wanted slots if given."""
    pairs = []
    for row, slot, whole in ngrams(buf, off):
        keep = np.flatnonzero(whole if wanted is None else whole & wanted[slot])
        pairs.append(row[keep].astype(np.int64) << TABLE_BITS | slot[keep])
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> TABLE_BITS, both & ((1 << TABLE_BITS) - 1)


def class_counts(train: DataFrame) -> DataFrame:
    """(slot, toxic, clean): documents of each class that hold the n-gram, summed
    in each task before the shuffle; 2^TABLE_BITS rows at most."""

    def run(batches):
        count = np.zeros((2, 1 << TABLE_BITS), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in chunks(batch.column(0)):
                row, slot = present(buf, off)
                for y in (0, 1):
                    count[y] += np.bincount(slot[label[lo:hi][row] == y], minlength=1 << TABLE_BITS)
        slot = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(count[1][slot]), pa.array(count[0][slot])], names=["slot", "toxic", "clean"])

    each = train.select(F.lower("text").alias("text"), "label").mapInArrow(run, "slot int, toxic long, clean long")
    return each.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """(weights by slot, bias). Without both classes among the labels all weights
    are 0 and the bias is the odds of the only class, bounded."""
    spark = docs.sparkSession
    train = labelled(docs, labels, "toxic", modulus, held, bound)
    size = train.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = max(size[0] or 0, 1), max(size[1] - (size[0] or 0), 1)
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (clean + 2))
    strength = F.abs("ratio") * F.sqrt(F.col("toxic") / toxic + F.col("clean") / clean)
    counts = class_counts(train).where("toxic + clean >= 3").withColumn("ratio", ratio).withColumn("strength", strength)
    best = counts.where("strength > 0").orderBy(F.desc("strength"), "slot").limit(KEPT).select("slot", "ratio").toPandas()
    slots, scale = best["slot"].to_numpy(np.int64), best["ratio"].to_numpy(float)
    index = np.full(1 << TABLE_BITS, -1, np.int32)
    index[slots] = np.arange(len(slots))
    shared = spark.sparkContext.broadcast(index)

    def rows(batches):
        for batch in batches:
            label = batch.column(1).to_pylist()
            for lo, hi, buf, off in chunks(batch.column(0)):
                row, slot = present(buf, off, shared.value >= 0)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                held_ = shared.value[slot]
                yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi], pa.int32()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(held_))], names=["label", "features"])

    sampled = train.select(F.lower("text").alias("text"), "label").mapInArrow(rows, "label int, features array<int>").toArrow()
    y = sampled.column("label").to_numpy().astype(float)
    lists = sampled.column("features").combine_chunks()
    columns = lists.flatten().to_numpy(zero_copy_only=False) if len(y) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(y) else np.zeros(0, np.int64)
    if not len(slots) or y.min() == y.max():
        return weights, (4.0 if len(y) and y.min() == 1 else -4.0)
    w, bias = logistic(row, columns, scale[columns], y, len(slots), RIDGE, weight=np.where(y == 1, (clean / toxic) ** RARE, 1.0))
    weights[slots] = w * scale
    return weights, bias


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(docs' doc_id, score) from whole texts; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            total = np.full(len(batch), bias)
            for lo, hi, buf, off in chunks(batch.column(1)):
                row, slot = present(buf, off, shared.value != 0)
                total[lo:hi] += np.bincount(row, shared.value[slot], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["row", "score"])

    kind = StructType().add("row", docs.schema).add("score", DoubleType())
    return docs.select(whole_row(docs).alias("row"), F.lower(F.col("text").cast("string")).alias("lowered")).mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    Only text is an input of a score. Null or empty text: the score of a text
    without n-grams. Labels that are null or neither 0 nor 1 are left out; a
    null doc_id is never labelled and counts as empty id for the fold. Repeated
    rows give repeated results; an empty table gives no rows.
    """
    weights, bias = fit(docs, labels, modulus, held, bound)
    scored = score(docs.select("doc_id", "text"), weights, bias)
    return scored.select(F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, columns as they are."""
    weights, bias = fit(docs, labels, bound=bound)
    return score(docs, weights, bias).where("score < 0.5").select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
