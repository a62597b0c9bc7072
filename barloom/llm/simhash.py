"""SimHash near-duplicates: fingerprints, then a bit-sliced search in radius 3.

Distinct fingerprints are dealt by two levels of pigeonhole keys (16 + 12 equal
bits of 64); inside a key's bucket, bit planes stand vertically in 64-bit words,
so that one carry-save step adds a differing bit for 64 candidates at once, and
words whose candidates all exceed the radius are dropped. A bucket above
`block` fingerprints is split into blocks, and each pair of blocks is a bucket
of its own, so no task holds more than two blocks and no pair is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import SALTS, checkpoint, chunks, components, doc_key, read, text_key

RADIUS = 3
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, word shingles hashed by XXH64 (seed
    42), repeats counted; a bit is 1 if set in over half the hashes. Fewer words
    than a shingle: the whole sequence; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    bounds = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = (bounds[shingle - 1 :] - 1).tolist()
    starts = [0, *bounds[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 4096):
        part = hashes[lo : lo + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, x, fp long): hash of the text, and the 64 bits as a signed long. Null and empty texts get 0."""

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch), np.uint64)
            for lo, hi, buf, off in chunks(batch.column(2)):
                raw = buf.tobytes()
                for i in range(lo, hi):
                    out[i] = fingerprint(raw[off[i - lo] : off[i - lo + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "x", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("x"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x long, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes, each of ceil(n / 64) words: bit i of plane b is bit b of values[i]."""
    n = -(-len(values) // 64) * 64
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, n - len(values)), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(diff, live: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Masks of the candidates with at most `radius` differing bits.

    diff(b, kept) gives plane b of the differences for the kept words of `live`
    (flat masks of the candidates that count). Carry-save counters, as many as the
    radius has binary digits, count the differing bits of 64 candidates at once; a
    carry out of the last one is beyond the radius for good, and so is a count above
    it. Every 8 planes, words whose candidates all exceed the radius are abandoned.
    """
    kept = np.flatnonzero(live)
    alive = live[kept]
    counters = [np.zeros_like(alive) for _ in range(max(1, int(radius).bit_length()))]
    for b in range(64):
        carry = diff(b, kept)
        for k, held in enumerate(counters):
            over = held & carry
            counters[k] = held ^ carry
            carry = over
        alive &= ~carry
        if b % 8 == 7:
            above, equal = np.zeros_like(alive), ~np.zeros_like(alive)  # compare the count with the radius, highest digit first
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal = equal & counters[k]
                else:
                    above |= equal & counters[k]
                    equal = equal & ~counters[k]
            alive &= ~above
            stay = alive != 0
            if not stay.all():
                kept, alive, counters = kept[stay], alive[stay], [x[stay] for x in counters]
                if not len(kept):
                    break
    out = np.zeros_like(live)
    out[kept] = alive
    return out


def set_bits(masks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(masks.view(np.uint8), bitorder="little"))


class Forest:
    """Union-find over the positions of one batch of buckets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def sliced(v: np.ndarray, radius: int = RADIUS):
    """(i, all j < i within the radius of i): queries against vertical planes."""
    size = len(v)
    planes = planes_of(v)
    width = planes.shape[1]
    step = max(1, (1 << 16) // max(width, 1))
    full = np.zeros(width * 64, np.uint8)
    full[:size] = 1
    lanes = np.packbits(full, bitorder="little").view(np.uint64)
    for q in range(0, size, step):
        mine = v[q : q + step]
        flip = np.where(np.unpackbits(mine.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), ~np.uint64(0), np.uint64(0))
        live = np.tile(lanes, len(mine))
        hits = within(lambda b, kept: planes[b][kept % width] ^ flip[b][kept // width], live, radius).reshape(len(mine), width)
        for i in range(len(mine)):
            near = set_bits(hits[i])
            yield q + i, near[near < q + i]


def bucket_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) that join every pair of one group within the radius into
    one tree per component; `group` is sorted."""
    n = len(fp)
    forest = Forest(n)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[begins, n])
    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    if small.any():  # all small groups at once: each row against the row r further on
        at = np.flatnonzero(small)
        g, v = group[at], fp[at]
        for r in range(1, int(sizes[(sizes > 1) & (sizes <= 64)].max())):
            near = np.flatnonzero(g[r:] == g[:-r])
            if not len(near):
                break
            planes, further = planes_of(v[near]), planes_of(v[near + r])
            full = np.zeros(planes.shape[1] * 64, np.uint8)
            full[: len(near)] = 1
            live = np.packbits(full, bitorder="little").view(np.uint64)
            for k in set_bits(within(lambda b, kept: planes[b][kept] ^ further[b][kept], live, radius)):
                forest.join(int(at[near[k]]), int(at[near[k] + r]))
    for lo, size in zip(begins[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        for i, near in sliced(fp[lo : lo + size], radius):
            for j in near.tolist():
                forest.join(lo + i, lo + j)
    roots = np.fromiter((forest.find(i) for i in range(n)), np.int64, n)
    child = np.flatnonzero(roots != np.arange(n))
    return roots[child], child


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (id, fp) within the
    radius: a tree per component of each bucket, so components are whole while
    no group emits all its pairs. Buckets are sorted by id: a lost task that runs
    again gives the same links."""
    keys = []
    for i in range(4):
        own = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
        low = F.col("fp").bitwiseAND((1 << 16 * i) - 1)
        rest = low.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * (i + 1)), 16 * i)) if i < 3 else low
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(own, 12)).bitwiseOR(part))
    dealt = distinct.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("large"), "n")
    many = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), many).cast("int")
    dealt = dealt.join(large, dealt.key == large.large, "left").select("id", "fp", "key", many.alias("many"), mine.alias("mine"))
    pairs = dealt.select("id", "fp", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("other"))
    pairs = pairs.select("id", "fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"))

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield linked([x[:cut] for x in now])
        if held is not None and len(held[0]):
            yield linked(held)

    def linked(columns):
        bucket, ids, fp = columns
        i, j = bucket_links(bucket, np.ascontiguousarray(fp).view(np.uint64), radius)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return pairs.select("bucket", "id", "fp").repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs, and (own, root, first) of each distinct one: the
    smallest fingerprint of its component, which tells components apart even where
    doc_ids are null or repeated, and its own first document (key, x)."""
    prints = checkpoint(fingerprints(docs))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min(F.struct(doc_key().alias("key"), "x")).alias("first")))
    found = components(near_links(distinct.select(F.col("fp").alias("id"), "fp"), radius, block))
    return prints, distinct.join(found, distinct.fp == found.id, "left").select(F.col("fp").alias("own"), F.coalesce("component", "fp").alias("root"), "first")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    Null or empty texts have fingerprint zero and link like any other; equal
    fingerprints always link. component_id is the smallest doc_id of the component.
    Repeated rows give repeated results; a null doc_id counts as the largest id and
    takes part, without linking what else has none. Other columns are ignored; an
    empty table gives no rows.
    """
    prints, named = grouped(docs, radius, block)
    least = named.groupBy(F.col("root").alias("top")).agg(F.min("first.key").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("top"))
    named = named.select("own", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # one fingerprint may stand for a third of all rows
    meet = (F.col("fp") == F.col("own")) & (F.pmod(F.xxhash64("doc_id", "x"), F.lit(SALTS)) == F.col("salt"))
    return prints.join(named, meet).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
