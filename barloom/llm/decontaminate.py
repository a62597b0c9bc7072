"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select token positions and ignore the others, so a substituted
token under a mask's gap does not hide a passage. Every position of every
document is hashed under every mask, once, and joined with the seeds of the
benchmark: by broadcast while these are few, by shuffle beyond. The overlap on a
hit's diagonal is then compared token by token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, doc_key, find_words, mix, range_hash, read, text_key, whole_row
from .substring import bit_table, in_table, slots

#: Masks of weight 6, 1 for a compared position; items too short for
#: them are seeds as a whole.
MASKS = ("111111", "110100111", "111001011", "101110011")
WHOLE = ("1", "11", "111", "1111", "11111")
#: A hit counts where this share of a stretch of SPAN tokens (or of the whole
#: item, if shorter) agrees.
SPAN = 20
SHARE = 0.8
#: Tokens of benchmark text up to which it is broadcast: some 15 MB with its seeds.
SHARD_TOKENS = 250_000
#: Pairs of positions that are sorted at once, and tokens compared at once.
PAIRS = 1 << 20

_NORM = np.arange(256, dtype=np.uint8)
_NORM[[i for i in range(128) if not chr(i).isalnum()]] = 32
_FACTORS = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters, digits and bytes beyond ASCII) and
    the index of each text's first."""
    plain = _NORM[buf]
    start, end, first = find_words(plain, off)
    return (range_hash(plain, start, end) if len(start) else np.zeros(0, np.uint64)), first


def seeds(word: np.ndarray, mask: str) -> np.ndarray:
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(word) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(int(mask, 2)))
    for i, factor in zip(at, _FACTORS, strict=False):
        total += word[i : i + n] * factor
    return mix(total)


def item_seeds(word: np.ndarray, first: np.ndarray):
    """(mask, seeds, positions) of the items in a slice, seeds of whole short items included."""
    row = np.searchsorted(first, np.arange(len(word)), "right") - 1
    length = np.diff(first)[row] if len(word) else row
    for mask in (*MASKS, *WHOLE):
        s = seeds(word, mask)
        whole = row[: len(s)] == row[len(mask) - 1 :][: len(s)]
        if mask in WHOLE:
            whole &= length[: len(s)] == len(mask)
        at = np.flatnonzero(whole)
        if len(at):
            yield mask, s[at], at


class Shard:
    """Tokens and sorted seeds of some benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        data = [t.lower().encode() for t in texts]
        off = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
        self.ids = np.array(ids, np.int64)
        self.word, self.first = tokens(np.frombuffer(b"".join(data), np.uint8), off)
        self.row = np.searchsorted(self.first, np.arange(len(self.word)), "right") - 1
        self.seed: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for mask, s, at in item_seeds(self.word, self.first):
            order = np.argsort(s, kind="stable")
            self.seed[mask] = s[order], at[order]
        every = np.concatenate([s for s, _ in self.seed.values()]) if self.seed else np.zeros(0, np.uint64)
        self.bits = max(16, int(len(every) * 16).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[every >> np.uint64(64 - self.bits)] = True

    def hits(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item row, diagonal): where item token 0 would lie in `word`, distinct.
        Pairs of positions are made and made distinct a bounded number at a time."""
        keys, width = np.zeros(0, np.int64), len(word) + len(self.word) + 1
        for mask, (seed, places) in self.seed.items():
            s = seeds(word, mask)
            pos = np.flatnonzero(self.table[s >> np.uint64(64 - self.bits)])
            lo, hi = np.searchsorted(seed, s[pos], "left"), np.searchsorted(seed, s[pos], "right")
            pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(n)
            begin = 0
            while begin < len(pos):
                base = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
                m = n[begin:end]
                pick = np.repeat(lo[begin:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                item = self.row[places[pick]]
                diagonal = np.repeat(pos[begin:end], m) - (places[pick] - self.first[item])
                keys = distinct_keys(keys, item * width + diagonal + len(self.word))
                begin = end
        return keys // width, keys % width - len(self.word)

    def matches(self, word: np.ndarray, first: np.ndarray, share: float):
        """(text, item row, matched, compared, start) of the best stretch that counts,
        for each text of a slice and each item."""
        item, diagonal = self.hits(word)
        bounds = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else np.zeros(1, int)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            mine = self.word[self.first[item[a]] : self.first[item[a] + 1]]
            yield from ((t, int(item[a]), *rest) for t, *rest in best_stretches(word, first, mine, diagonal[a:b], share))


def distinct_keys(known: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Sorted distinct values of both; a dense range of new ones is counted, not sorted."""
    lo, hi = int(more.min()), int(more.max())
    if hi - lo < 8 * len(more):
        there = np.zeros(hi - lo + 1, bool)
        there[more - lo] = True
        more = np.flatnonzero(there) + lo
    else:
        more = np.unique(more)
    return np.union1d(known, more) if len(known) else more


def best_stretches(word: np.ndarray, first: np.ndarray, mine: np.ndarray, diagonal: np.ndarray, share: float):
    """(text, matched, compared, start in the text) of the best stretch on some diagonals
    of one item, for each text that holds one with at least `share` of equal tokens."""
    size, span = len(mine), min(SPAN, len(mine))
    wide = len(word) + 1
    best = np.full(len(first), -1, np.int64)  # of each text: agreeing tokens, then the earliest start
    step = max(1, PAIRS // size)
    for k in range(0, len(diagonal), step):
        d = diagonal[k : k + step]
        at = d[:, None] + np.arange(size)
        there = np.clip(at, 0, len(word) - 1)
        same = np.zeros((len(d), size + 1), np.int32)
        np.cumsum((word[there] == mine) & (at == there), axis=1, out=same[:, 1:])
        runs = same[:, span:] - same[:, :-span]
        i, j = np.nonzero(runs >= share * span)
        start, n = d[i] + j, runs[i, j].astype(np.int64)
        inside = np.flatnonzero((start >= 0) & (start + span <= len(word)))
        start, n = start[inside], n[inside]
        text = np.searchsorted(first, start, "right") - 1
        whole = np.flatnonzero(start + span <= first[np.minimum(text + 1, len(first) - 1)])
        np.maximum.at(best, text[whole], n[whole] * wide + (wide - 1 - start[whole]))
    return [(t, int(best[t] // wide), span, int(wide - 1 - best[t] % wide - first[t])) for t in np.flatnonzero(best >= 0).tolist()]


FOUND = ("doc", "x", "item_id", "matched", "compared", "start")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
SCHEMA = "doc long, x long, item_id long, matched int, compared int, start long"


def found_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FOUND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=list(FOUND))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc, x, item_id, matched, compared, start): the best stretch that counts of
    each document (doc and the text hash x) and each item. The documents' positions
    are hashed in one pass, whatever the size of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("said")).where("item_id is not null and said is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("said", r"[^\p{L}\p{N}]+")).cast("long"))).first()[0] or 0
    texts = docs.select(doc_key().alias("doc"), text_key().alias("x"), F.lower(F.col("text").cast("string")).alias("text"))
    if total > shard_tokens:
        return matches_by_shuffle(texts, items, share)
    part = items.orderBy("item_id", "said").toArrow()  # shard_tokens bounds it
    shared = spark.sparkContext.broadcast(Shard(part.column("item_id").to_pylist(), part.column("said").to_pylist()))

    def run(batches):
        shard = shared.value
        for batch in batches:
            ids, x, rows = batch.column(0), batch.column(1), []
            for at, _, buf, off in chunks(batch.column(2)):
                word, first = tokens(buf, off)
                rows += [(ids[at + text].as_py(), x[at + text].as_py(), int(shard.ids[item]), *rest) for text, item, *rest in shard.matches(word, first, share)]
            yield found_batch(rows)

    return texts.mapInArrow(run, SCHEMA)


def matches_by_shuffle(texts: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """The same for a benchmark of any size. A bit table of fixed size tells which
    positions of documents may meet a seed; positions of one seed travel as one list
    for each document and each item, and pairs are made where the texts are compared."""

    def of_items(batches):
        for batch in batches:
            ids, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, buf, off in chunks(batch.column(2)):
                word, first = tokens(buf, off)
                for _, s, at in item_seeds(word, first):
                    row = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s.view(np.int64), ids[lo + row], y[lo + row], at - first[row])], names=["seed", "item_id", "y", "at"])

    items = items.withColumn("y", F.xxhash64("said"))
    known = items.select("item_id", "y", "said").mapInArrow(of_items, "seed long, item_id long, y long, at long").groupBy("seed", "item_id", "y").agg(F.collect_list("at").alias("places"))
    lengths = {r[0] for r in items.select(F.size(F.array_remove(F.split("said", r"[^\p{L}\p{N}]+"), "")).alias("n")).where(f"n <= {len(WHOLE)}").distinct().collect()}  # five values at most
    masks = (*MASKS, *(m for m in WHOLE if len(m) in lengths))
    table = bit_table(known.select("seed"))

    def of_docs(batches):
        for batch in batches:
            ids, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, buf, off in chunks(batch.column(2)):
                word, first = tokens(buf, off)
                row = np.searchsorted(first, np.arange(len(word)), "right") - 1
                for mask in masks:
                    s = seeds(word, mask)
                    at = np.flatnonzero((row[: len(s)] == row[len(mask) - 1 :][: len(s)]) & in_table(table, slots(s)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (s[at].view(np.int64), ids[lo + row[at]], x[lo + row[at]], at - first[row[at]])], names=["seed", "doc", "x", "pos"])

    asked = texts.mapInArrow(of_docs, "seed long, doc long, x long, pos long").groupBy("seed", "doc", "x").agg(F.collect_list("pos").alias("asked"))
    met = asked.join(known, "seed").groupBy("doc", "x", "item_id", "y").agg(F.collect_list(F.struct("asked", "places")).alias("met"))
    full = met.join(items.withColumnRenamed("item_id", "own"), (F.col("item_id") == F.col("own")) & (met.y == items.y)).select("doc", "x", "item_id", "said", "met")
    full = full.join(texts.select(F.col("doc").alias("d"), F.col("x").alias("dx"), "text").distinct(), (F.col("doc") == F.col("d")) & (F.col("x") == F.col("dx")))

    def compare(batches):
        for batch in batches:
            rows = []
            doc, x, ids, said, asked, places, text = (batch.column(k) for k in range(7))
            for i in range(len(batch)):
                word, first = tokens(*_alone(text[i].as_py()))
                mine, _ = tokens(*_alone(said[i].as_py()))
                there = np.zeros(len(word) + len(mine) + 1, bool)
                for pos, at in zip(asked[i].as_py(), places[i].as_py(), strict=True):
                    pos = np.array(pos)
                    for p in at:
                        there[pos - p + len(mine)] = True
                found = best_stretches(word, first, mine, np.flatnonzero(there) - len(mine), share)
                rows += [(doc[i].as_py(), x[i].as_py(), ids[i].as_py(), *rest) for _, *rest in found]
            yield found_batch(rows)

    return full.select("doc", "x", "item_id", "said", "met.asked", "met.places", "text").mapInArrow(compare, SCHEMA)


def _alone(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, item_id, matched, compared, start): each pair of a document and a
    benchmark item that shares a stretch of `compared` tokens (20, or the whole
    item) with at least `share` of them equal; start is the stretch's first token.

    Items under six tokens count where a document holds all of their tokens in
    order. Items without item_id take no part; null and empty texts match nothing;
    empty tables give no rows. A null doc_id comes back as null; repeated rows give one row for each pair, and
    so do several texts under one doc_id, or without any.
    """
    best = matches(docs, benchmark, share, shard_tokens).groupBy("doc", "item_id").agg(F.max(F.struct("matched", "compared", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.when(F.col("doc") != (1 << 63) - 1, F.col("doc")).alias("doc_id"), "item_id", "best.matched", "best.compared", (-F.col("best.back")).alias("start"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that share no passage with the benchmark, columns as they are.

    Null and empty texts share nothing and stay; rows that repeat a document go or
    stay together, texts under one doc_id or none each by itself; an empty benchmark
    keeps every row, an empty table gives none; columns of any name may stand in docs."""
    found = matches(docs, benchmark).select(F.col("doc").alias("leaked"), F.col("x").alias("leaked_x")).distinct()
    rows = docs.select(doc_key().alias("own_id"), text_key().alias("own_x"), whole_row(docs).alias("row"))
    stay = rows.join(found, (F.col("own_id") == F.col("leaked")) & (F.col("own_x") == F.col("leaked_x")), "left_anti")
    return stay.select(*[F.col("row")[n].alias(n) for n in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
