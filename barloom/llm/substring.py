"""Substring dedup: windows of 20 words that start earlier elsewhere are removed.

Matching statistics against suffix automata of reference shards. A shard is
what one anchor gathers: every window belongs to the anchor (least hash of its
four-word sequences, leftmost of equals), so equal windows always meet in one
shard, and neighbouring windows travel together as one fragment. A shard's
automaton is grown from its distinct fragments in order of first occurrence,
and each fragment is streamed through it before it is added: where the longest
match reaches 20 words, the window ending there starts earlier.

The reference is the corpus itself and grows with it, so whole automata are not
broadcast: shards are co-partitioned with the fragments. Only bit tables of
fixed size are broadcast (anchors seen twice or more; first occurrences whose
shard holds more than one fragment); as they fill, more fragments travel, and
the result stays the same. Equal fragments are combined before any shuffle of
words, and shards of frequent anchors fall apart into shards of one window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from .common import checkpoint, chunks, doc_key, find_words, mix, quoted, range_hash, read, text_key

WINDOW = 20
GRAM = 4
#: Bits of a broadcast table: 4 MB, whatever the input.
TABLE_BITS = 25
#: An anchor with more distinct fragments is dealt out by single windows.
FREQUENT = 1000


class Automaton:
    """Suffix automaton of several word sequences (Blumer et al.), online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def extend(self, last: int, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        if word in nxt[last]:
            q = nxt[last][word]
            if size[last] + 1 == size[q]:
                return q
            return self._clone(last, q, word)
        here = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = here
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[here] = q if size[p] + 1 == size[q] else self._clone(p, q, word)
        return here

    def _clone(self, p: int, q: int, word) -> int:
        nxt, link, size = self.next, self.link, self.size
        twin = len(size)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = twin
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = twin
            p = link[p]
        return twin

    def matched(self, words, window: int) -> int:
        """Bits of the windows of `words` that occur in the automaton: bit i for
        the window that starts at word i."""
        nxt, link, size = self.next, self.link, self.size
        state = length = bits = 0
        for at, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                length = size[state]
            if word in nxt[state]:
                state = nxt[state][word]
                length += 1
            if length >= window:
                bits |= 1 << (at - window + 1)
        return bits

    def add(self, words) -> None:
        last = 0
        for word in words:
            last = self.extend(last, word)


def fragments(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Fragments of the texts in one slice: (row, first window's word index in its
    text, windows, anchor hash, first byte, last byte, hash of all it holds)."""
    start, end, first = find_words(buf, off)
    n = len(start) - window + 1
    if n <= 0:
        return None
    word = range_hash(buf, start, end)
    row = np.searchsorted(first, np.arange(len(start)), "right") - 1
    grams = range_hash(word, np.arange(len(start) - gram + 1), np.arange(gram, len(start) + 1))
    best, at = grams, np.arange(len(grams))
    have, width = 1, window - gram + 1
    while have < width:  # least hash of each run of `width` grams, the leftmost of equals
        step = min(have, width - have)
        left, right = slice(0, len(best) - step), slice(step, None)
        less = best[right] < best[left]
        best, at = np.where(less, best[right], best[left]), np.where(less, at[right], at[left])
        have += step
    whole = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(whole):
        return None
    anchor, own = at[whole], row[whole]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
    a = whole[cut]
    count = np.diff(np.r_[cut, len(whole)])
    last = a + count + window - 1
    content = mix(range_hash(word, a, last) ^ (anchor[cut] - a).astype(np.uint64) ^ grams[anchor[cut]] * np.uint64(0x9FB21C651E98DF25))
    return row[a], a - first[row[a]], count, grams[anchor[cut]], start[a], end[last - 1], content


def slots(*columns: np.ndarray) -> np.ndarray:
    """Slot of each row in a bit table."""
    total = np.zeros(len(columns[0]), np.uint64)
    for k, column in enumerate(columns):
        total = mix(total ^ column.astype(np.int64).view(np.uint64) + np.uint64(k))
    return (total >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def bit_table(rows: DataFrame):
    """Broadcast table of 2^TABLE_BITS bits with one bit set for each row (of
    longs); the driver gets its words, 2^TABLE_BITS / 32 rows at most."""
    width = len(rows.columns)

    def run(batches):
        table = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            table[slots(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)))] = True
        words = np.packbits(table, bitorder="little").view(np.uint32)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at].view(np.int32))], names=["word", "bits"])

    found = rows.mapInArrow(run, "word int, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 5), np.int32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def in_table(table, slot: np.ndarray) -> np.ndarray:
    return (table.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def of_texts(docs: DataFrame, window: int, emit, schema: str) -> DataFrame:
    """Rows that emit(bytes, (doc ids, text hashes), (h, f, pos, n, first byte, last
    byte)) makes of the fragments of each slice of whole texts. Id and text hash
    together are the document."""

    def run(batches):
        for batch in batches:
            ids, x = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, _, buf, off in chunks(batch.column(2)):
                if (found := fragments(buf, off, window)) is not None:
                    row, pos, n, h, first, last, f = found
                    names, columns = emit(buf, (ids[row + lo], x[row + lo]), (h.view(np.int64), f.view(np.int64), pos, n, first, last))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(doc_key().alias("doc"), text_key().alias("x"), F.col("text").cast("string")).mapInArrow(run, schema)


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h) of every fragment, to 40 bits: enough to tell which come back."""
    return of_texts(docs, window, lambda buf, ids, found: (["h"], [pa.array(found[0] & SHORT)]), "h long")


SHORT = (1 << 40) - 1


def occurrences(docs: DataFrame, window: int, repeated) -> DataFrame:
    """(h, f, doc, x, at) of the fragments whose anchor comes back; at: position * 32 + windows."""

    def emit(buf, ids, found):
        h, f, pos, n, _, _ = found
        keep = np.flatnonzero(in_table(repeated, slots(h & SHORT)))
        return ["h", "f", "doc", "x", "at"], [pa.array(c[keep]) for c in (h, f, *ids, pos * 32 + n)]

    return of_texts(docs, window, emit, "h long, f long, doc long, x long, at long")


def chosen(found, ids, firsts, frequent, wanted: bool) -> np.ndarray:
    """The fragments that are first occurrences in the table, of frequent anchors only
    or of the others only."""
    h, f, pos = found[:3]
    return np.flatnonzero(in_table(firsts, slots(f, *ids, pos)) & (in_table(frequent, slots(h)) == wanted))


def wordings(docs: DataFrame, window: int, firsts, frequent) -> DataFrame:
    """(h, f, doc, x, pos, words) of the first occurrences in the table whose anchor is not frequent."""

    def emit(buf, ids, found):
        h, f, pos, n, first, last = found
        keep = chosen(found, ids, firsts, frequent, False)
        raw = buf.tobytes()
        words = [raw[i:j] for i, j in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
        return ["h", "f", "doc", "x", "pos", "words"], [*(pa.array(c[keep]) for c in (h, f, *ids, pos)), pa.array(words, pa.binary())]

    return of_texts(docs, window, emit, "h long, f long, doc long, x long, pos long, words binary")


def match_shards(fragment: DataFrame, window: int) -> DataFrame:
    """(f, bits): the windows of each distinct fragment that an earlier one of
    its shard holds, if any."""

    def run(batches):
        held, shard, at, seen = None, None, None, set()
        for batch in batches:
            rows, out = batch.column(1).to_pylist(), []
            for key, f, text in zip(batch.column(0).to_pylist(), rows, batch.column(5).to_pylist(), strict=True):
                if key != at:
                    at, shard, held, seen = key, None, text, {f}
                elif f not in seen:
                    seen.add(f)
                    if shard is None:
                        shard = Automaton()
                        shard.add(held.split())
                    mine = text.split()
                    if bits := shard.matched(mine, window):
                        out.append((f, bits))
                    shard.add(mine)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["f", "bits"])

    return fragment.repartition("h").sortWithinPartitions("h", "doc", "x", "pos").mapInArrow(run, "f long, bits long")


def match_windows(docs: DataFrame, window: int, firsts, frequent) -> DataFrame:
    """The same for frequent anchors: a shard for each window, combined before the
    shuffle. The windows come straight from the scan. Later copies of a fragment
    that the table lets through fall to its first occurrence."""

    def emit(buf, ids, found):
        h, f, pos, n, first, last = found
        keep = chosen(found, ids, firsts, frequent, True)
        raw, rows = buf.tobytes(), []
        for x, d, y, p, i, j in zip(*(c[keep].tolist() for c in (f, *ids, pos, first, last)), strict=True):
            words = raw[i:j].split()
            rows += [(x, d, y, p + k, k, hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest()) for k in range(len(words) - window + 1)]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return ["f", "doc", "x", "pos", "i", "w"], [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]

    each = of_texts(docs, window, emit, "f long, doc long, x long, pos long, i int, w binary")
    each = each.groupBy("f", "i", "w").agg(F.min(F.struct("doc", "x", "pos")).alias("at"))
    first = each.groupBy("w").agg(F.min("at").alias("first"))
    later = each.join(first, "w").where(F.col("at") != F.col("first"))
    return later.groupBy("f").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, frequent: int = FREQUENT) -> DataFrame:
    """(doc, x, pos, bits): a set bit i says that the window at word pos + i of the
    document starts earlier in the corpus (smaller doc_id, of one id smaller text
    hash x, or same document and earlier word)."""
    again = anchors(docs, window).groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    repeated = bit_table(again)
    every = occurrences(docs, window, repeated)
    distinct = every.groupBy("h", "f").agg(F.min(F.struct("doc", "x", "at")).alias("first"), F.count("*").alias("times"))
    distinct = checkpoint(distinct.select("h", "f", F.col("first.doc").alias("doc0"), F.col("first.x").alias("x0"), F.col("first.at").alias("at0"), "times"))
    shared = checkpoint(distinct.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("h").alias("shared"), "kinds"))
    often = shared.where(F.col("kinds") > frequent).select(F.col("shared").alias("h"))
    in_shared = distinct.join(shared, distinct.h == shared.shared).select("f", "doc0", "x0", F.floor(F.col("at0") / 32).alias("pos0"))
    firsts, frequent_table = bit_table(in_shared), bit_table(often)
    matched = match_shards(wordings(docs, window, firsts, frequent_table), window)
    if not often.isEmpty():
        matched = matched.union(match_windows(docs, window, firsts, frequent_table))
    known = distinct.where("times > 1").select("f", "doc0", "x0", "at0").join(matched.withColumnRenamed("f", "f1"), F.col("f") == F.col("f1"), "full")
    known = known.select(F.coalesce("f", "f1").alias("f0"), "doc0", "x0", "at0", F.coalesce("bits", F.lit(0)).alias("bits"))
    first = F.col("doc0").isNull() | ((F.col("doc") == F.col("doc0")) & (F.col("x") == F.col("x0")) & (F.col("at") == F.col("at0")))
    bits = F.when(first, F.col("bits")).otherwise(F.expr("shiftleft(1L, cast(at % 32 as int)) - 1"))
    every = every.select("f", "doc", "x", "at").join(known, F.col("f") == F.col("f0"))
    return every.select("doc", "x", F.floor(F.col("at") / 32).alias("pos"), bits.alias("bits")).where("bits != 0")


def dedup_texts(docs: DataFrame, window: int = WINDOW, frequent: int = FREQUENT) -> DataFrame:
    """docs with the columns kept_text, n_words and n_removed added: the kept words
    joined by one space.

    Null text: no words, kept_text ''. Texts shorter than the window lose
    nothing; an empty table gives no rows. Rows that repeat a doc_id with the
    same text count as one document and get the same result; other texts under one
    doc_id, or without any, are documents of their own, in order of a hash of the
    text. A null doc_id sorts last. Columns of docs by the added names are replaced.
    """
    spans = repeated_spans(docs, window, frequent).groupBy("doc", "x").agg(F.collect_list(F.struct("pos", "bits")).alias("spans"))
    given = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    source = docs.select(F.struct(*map(quoted, given)).alias("row"), doc_key().alias("key"), text_key().alias("text_hash"))
    joined = source.join(spans, (F.col("key") == F.col("doc")) & (F.col("text_hash") == F.col("x")), "left").select(F.col("row.text").cast("binary").alias("text"), "spans.pos", "spans.bits", "row")

    def run(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            starts, bits = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, pos, mask in zip(batch.column(0).to_pylist(), starts, bits, strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if pos:
                    gone = bytearray(len(words))
                    for p, m in zip(pos, mask, strict=True):
                        while m:
                            low = (m & -m).bit_length() - 1
                            run_ = ((m >> low) + 1 & ~(m >> low)).bit_length() - 1
                            gone[p + low : p + low + run_ + window - 1] = b"\1" * (run_ + window - 1)
                            m &= ~(((1 << run_) - 1) << low)
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(kept, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "kept", "n_words", "n_removed"])

    kind = StructType().add("row", joined.schema["row"].dataType).add("kept", BinaryType()).add("n_words", LongType()).add("n_removed", LongType())
    out = joined.mapInArrow(run, kind)
    return out.select("row.*", F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_texts(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as k from (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) as i from w)),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as p from later),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as said from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(said, '')) as kept_sha256
from w left join kept using (doc_id)"""
