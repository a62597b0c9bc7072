"""Shared helpers of the training-data operators: checkpoints, vectorised
word hashing inside tasks, and connected components over an edge table."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: bytes.split() and str.encode().split() cut at exactly these bytes: the word
#: pattern of every operator here is [^\x20\x09-\x0D]+ over UTF-8 text.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Stands for a null id where ids are compared or joined: it sorts last.
NO_ID = (1 << 63) - 1

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder that
    spark.checkpoint.dir names. Where that is unset, a local master (tests) gets a
    new folder of its own; a cluster is an error, as executors share no local folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_key(name: str = "text") -> Column:
    """Hash of a text: with doc_key, the identity of a document. Null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def quoted(name: str) -> Column:
    """A top-level column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """A row as one struct: its names can't clash with those used beside it."""
    return F.struct(*[quoted(c) for c in docs.columns])


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the folds of the labelled operators."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in wrapping arithmetic."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def powers(n: int, _kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """R^i and R^-i modulo 2^64 for i < n, kept for the worker's next call."""
    if not _kept or len(_kept[0]) < n:
        n = max(n, 1 << 18)
        up, down = np.full(n, _R, np.uint64), np.full(n, _R_INV, np.uint64)
        up[0] = down[0] = 1
        _kept[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _kept[0][:n], _kept[1][:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each pair of bounds, from one running sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def chunks(column, limit: int = 1 << 18):
    """Slices of an Arrow string column of about `limit` bytes (a longer text
    is a slice of its own): (first row, row after the last, bytes, bounds).
    Null texts are empty."""
    buffers, n = column.buffers(), len(column)
    if not n:
        return
    wide = str(column.type).startswith("large")
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def find_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each text's first word
    (one entry more than texts). No word spans two texts."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[(off > 0) & (off < len(buf))]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


#: Neighbours from which on an id is a hub, and salts of a label that many ids share.
HUB, SALTS = 1000, 8


def components(edges: DataFrame, rounds: int = 60, hub: int = HUB) -> DataFrame:
    """Connected components of undirected links (a long, b long), as (id,
    component): the smallest id reachable. Ids without links are absent.

    Each round takes the smallest label among the neighbours (a map-side
    combined minimum) and then jumps to the label of that label, so long chains
    halve; the round's labels are checkpointed. No id gathers its neighbours: the
    labels of hubs (a thousandth of all links and more, two thousand ids at most)
    are broadcast, and labels that many ids share are met by salt. Self links,
    repeated links and links in both directions are fine; an empty table gives no
    rows. Links are evaluated once for both directions, as a second evaluation of a
    search may pick other links of the same component.
    """
    there, back = F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))
    both = edges.where("a != b").select(F.explode(F.array(there, back)).alias("link")).select("link.*")
    both = checkpoint(both.distinct())
    degree = both.groupBy("src").agg(F.min(F.least("src", "dst")).alias("component"), F.count("*").alias("n"))
    known = checkpoint(degree.select(F.col("src").alias("id"), "component", "n"))
    most = max(hub, (known.agg(F.sum("n")).first()[0] or 0) // 1000)
    hubs = checkpoint(known.where(F.col("n") > most).select("id"))
    some = not hubs.isEmpty()
    if some:
        is_hub = F.broadcast(hubs.select(F.col("id").alias("dst")))
        rare, frequent = checkpoint(both.join(is_hub, "dst", "left_anti")), checkpoint(both.join(is_hub, "dst", "left_semi"))
    else:
        rare = both
    labels = known.select("id", "component")
    for _ in range(rounds):
        heard = rare.join(labels, rare.dst == labels.id).select("src", "component")
        if some:
            told = labels.join(F.broadcast(hubs), "id", "left_semi")
            heard = heard.union(frequent.join(F.broadcast(told), frequent.dst == told.id).select("src", "component"))
        near = heard.groupBy("src").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.id == near.src, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("goal"), F.col("component").alias("was"))
        goals = moved.select(F.col("goal").alias("at")).distinct()
        jump = moved.select(F.col("id").alias("own"), F.col("goal").alias("next")).join(goals, F.col("own") == F.col("at"), "left_semi")
        jump = jump.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        meet = (F.col("goal") == F.col("own")) & (F.pmod(F.xxhash64("id"), F.lit(SALTS)) == F.col("salt"))
        moved = checkpoint(moved.join(jump, meet, "left").select("id", F.least("goal", F.coalesce("next", "goal")).alias("component"), "was"))
        labels = moved.select("id", "component")
        if moved.where("component != was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
