"""Near copies by SimHash on five-word shingles, a similarity of 0.8 and more.

Texts with equal sets of five-word shingles are one node. Buckets of nodes that
agree in a band of minima bound the search; buckets of the same members are one.
Inside a bucket the nodes' SimHash fingerprints stand in vertical bit planes, and
the bit-sliced comparison of the SimHash operator, with a radius wide enough for
the similarity, leaves the pairs whose whole sets are then compared exactly. A
bucket above `block` nodes is split into blocks, and each pair of blocks is a
bucket of its own, so no pair is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, chunks, components, doc_key, find_words, mix, range_hash, text_key, whole_row
from .simhash import sliced
from .substring import bit_table, in_table, slots

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of minima: at a similarity of 0.8, one pair in 2,900 shares no band.
BANDS, ROWS = 20, 5
BLOCK = 1024
#: Differing bits of 64 up to which sets are compared: at a similarity of 0.8 a
#: pair has 9.7 on average, with a deviation of 2.9.
RADIUS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_MASKS) | np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, A-Z lower-cased. Fewer
    words than a shingle: the whole sequence; none: an empty set."""
    plain = _LOWER[buf]
    start, end, first = find_words(plain, off)
    word = range_hash(plain, start, end) if len(start) else np.zeros(0, np.uint64)
    n = np.diff(first)
    size = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    begin = np.cumsum(size) - size
    at = np.repeat(first[:-1] - begin, size) + np.arange(int(size.sum()))
    grams = range_hash(word, at, at + np.repeat(np.minimum(n, shingle), size)) if len(at) else word
    return [np.unique(grams[b : b + s]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def node(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(sets: list[np.ndarray]) -> list[list[int]]:
    """Of each set, one hash for each band of minima; none for an empty set."""
    found: list[list[int]] = [[] for _ in sets]
    some = [k for k, members in enumerate(sets) if len(members)]
    if some:
        every = np.concatenate([sets[k] for k in some])
        size = np.array([len(sets[k]) for k in some])
        begin = np.cumsum(size) - size
        least = np.stack([np.minimum.reduceat((every ^ m) * f, begin) for m, f in zip(_MASKS, _FACTORS, strict=True)], axis=1).ravel()
        at = np.arange(len(some) * BANDS) * ROWS
        hashed = range_hash(least, at, at + ROWS).view(np.int64).reshape(-1, BANDS)
        for k, row in zip(some, hashed.tolist(), strict=True):
            found[k] = row
    return found


def sketches(docs: DataFrame) -> DataFrame:
    """(doc, x, t, bands): row identity, node and bands of each text."""

    def run(batches):
        for batch in batches:
            t, found = [], []
            for _, _, buf, off in chunks(batch.column(2)):
                sets = shingle_sets(buf, off)
                t += map(node, sets)
                found += bands(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc", "x", "t", "bands"])

    return docs.select(doc_key().alias("doc"), text_key().alias("x"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc long, x long, t long, bands array<long>")


def wanted_sets(docs: DataFrame, wanted) -> DataFrame:
    """(t, fp, members) of the documents in the table."""

    def run(batches):
        for batch in batches:
            ids, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keep = np.flatnonzero(in_table(wanted, slots(ids, x)))
            t, fp, raw = [], [], []
            for _, _, buf, off in chunks(batch.column(2).take(pa.array(keep))):
                for members in shingle_sets(buf, off):
                    t.append(node(members))
                    fp.append(fingerprint(members))
                    raw.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(fp, pa.int64()), pa.array(raw, pa.binary())], names=["t", "fp", "members"])

    return docs.select(doc_key().alias("doc"), text_key().alias("x"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "t long, fp long, members binary")


def fingerprint(members: np.ndarray) -> int:
    """SimHash of a set of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(members), 4096):
        ones += np.unpackbits(members[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(members), bitorder="little").view(np.int64)[0])


def similar(sets: list[np.ndarray], prints: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Positions that join every pair of at least this Jaccard similarity into one
    tree per component."""
    size = np.array([len(s) for s in sets])
    group, links = np.arange(len(sets)), []
    for i, near in sliced(prints, RADIUS):
        own = sets[i]
        near = near[np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-9]
        while len(near := near[group[near] != group[i]]):
            part, near = near[:16], near[16:]
            every = np.concatenate([sets[j] for j in part])
            place = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(size[part]) - size[part])
            for j in part[both >= similarity * (size[i] + size[part] - both) - 1e-9].tolist():
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    links.append((i, j))
    return links


def near_nodes(docs: DataFrame, distinct: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) between nodes: a tree per component of each bucket. Buckets are
    sorted by node: a lost task that runs again gives the same links."""
    dealt = checkpoint(distinct.select("t", F.posexplode("bands").alias("k", "band")).select("t", F.xxhash64("k", "band").alias("key")))
    alike = F.xxhash64("t", F.lit(1))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(alike).alias("p"), F.bit_xor(F.xxhash64("t", F.lit(2))).alias("q")).where("n > 1")
    shared = shared.select(F.col("key").alias("own"), F.xxhash64("n", "p", "q").alias("bucket"), "n")
    many = F.ceil(F.col("n") / block).cast("int")
    buckets = dealt.join(shared, F.col("key") == F.col("own")).groupBy("t", "bucket").agg(F.max(many).alias("many"))
    buckets = buckets.withColumn("mine", F.pmod(alike, F.col("many")).cast("int")).select("t", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
    buckets = checkpoint(buckets.select(F.col("t").alias("t1"), F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket")))
    chosen = distinct.join(buckets.select("t1").distinct(), F.col("t") == F.col("t1"), "left_semi").select("first.doc", "first.x")
    sets = wanted_sets(docs, bit_table(chosen)).groupBy("t").agg(F.first("fp").alias("fp"), F.first("members").alias("members"))

    def run(batches):
        at, ids, prints, sets = None, [], [], []

        def linked():
            found = similar(sets, np.array(prints, np.int64).view(np.uint64), similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for bucket, t, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    yield linked()
                    at, ids, prints, sets = bucket, [], [], []
                ids.append(t)
                prints.append(fp)
                sets.append(np.frombuffer(raw, np.uint64))
        yield linked()

    rows = buckets.join(sets, F.col("t1") == F.col("t")).select("bucket", "t", "fp", "members")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "t").mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, one document of each group of near copies, that
    of the smallest doc_id (of one doc_id, the least hash of the text); the columns
    stay as they are.

    A pair is near if the Jaccard similarity of its five-word shingle sets is at
    least `similarity`; groups are chains of pairs. Null and empty texts are alike.
    Rows that repeat a doc_id with its text are one document and stay together; a
    null doc_id sorts last. An empty table gives no rows.
    """
    distinct = sketches(docs).groupBy("t").agg(F.min(F.struct("doc", "x")).alias("first"), F.first("bands").alias("bands"))
    distinct = checkpoint(distinct)
    found = components(near_nodes(docs, distinct, similarity, block))
    kept = distinct.join(found, F.col("t") == F.col("id"), "left").groupBy(F.coalesce("component", "t").alias("root")).agg(F.min("first").alias("kept"))
    kept = kept.select(F.col("kept.doc").alias("kept_id"), F.col("kept.x").alias("kept_x"))
    rows = docs.select(doc_key().alias("own_id"), text_key().alias("own_x"), whole_row(docs).alias("row"))
    stay = rows.join(kept, (F.col("own_id") == F.col("kept_id")) & (F.col("own_x") == F.col("kept_x")), "left_semi")
    return stay.select(*[F.col("row")[n].alias(n) for n in docs.columns])
