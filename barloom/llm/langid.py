"""Language ID by mixture inference.

Per-language likelihoods of hashed byte trigrams (within words, with their edges)
are summed over the labelled training rows. A document is a mixture: its words
are drawn from languages in unknown proportions, which expectation-maximisation
estimates from the words' likelihoods; nested sets of languages, in order of
their share, are compared by penalised likelihood, and the set's largest share
names the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, chunks, doc_key, fold, find_words, read

#: Training rows of one language, about; and the table's bits.
SAMPLE_ROWS = 4000
TABLE_BITS = 16
#: Steps of each fit.
STEPS = 6
#: Penalty of one more language, in units of log(words) / 2 (BIC).
PENALTY = 2.0

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def word_trigrams(buf: np.ndarray, off: np.ndarray):
    """(first word of each text, first trigram of each word, slot of each
    trigram): a word of n bytes has n, with a space before and after it."""
    plain = _PLAIN[buf]
    start, end, first = find_words(plain, off)
    if not len(start):
        return first, np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - start
    begin = np.cumsum(size) - size
    here = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    middle = plain[here].astype(np.uint32)
    before, after = np.empty_like(middle), np.empty_like(middle)
    before[1:], after[:-1] = middle[:-1], middle[1:]
    before[begin] = 32
    after[begin + size - 1] = 32
    slot = ((before << np.uint32(16) | middle << np.uint32(8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)
    return first, begin, slot


def fit(docs: DataFrame, bound: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and log-likelihoods (slot, language)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1))
    rows = rows.select(doc_key().alias("key"), F.col("lang").cast("string").alias("lang"), "text")
    there = checkpoint(rows.groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n")))
    kinds = [r[0] for r in there.select("kind").orderBy("kind").collect()]  # one name for each column of the table
    if not kinds:
        return [], np.zeros((1 << TABLE_BITS, 0))
    spread = 1 << 30
    rows = rows.join(F.broadcast(there), F.col("lang") == F.col("kind")).where(F.pmod(F.xxhash64("key", F.lit("lang")), F.lit(spread)) < F.lit(bound) / F.col("n") * spread)

    def run(batches):
        count: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, buf, off in chunks(batch.column(0)):
                first, begin, slot = word_trigrams(buf, off)
                row = np.repeat(np.arange(hi - lo), np.diff(np.r_[begin, len(slot)][first]))
                for kind in set(lang[lo:hi]):
                    own = slot[(lang[lo:hi] == kind)[row]]
                    count[kind] = count.get(kind, 0) + np.bincount(own, minlength=1 << TABLE_BITS)
        for kind, n in count.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "slot", "n"])

    counts = rows.select(F.lower(F.col("text").cast("string")).alias("text"), "lang").mapInArrow(run, "lang string, slot int, n long")
    counts = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((1 << TABLE_BITS, len(kinds)), 0.1)
    table[counts["slot"].to_numpy(int), [kinds.index(x) for x in counts["lang"]]] += counts["n"].to_numpy(float)
    return kinds, np.log(table / table.sum(axis=0)).astype(np.float32)


def mixtures(likelihood: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the language with the largest share in the set of the best
    penalised likelihood, and its share. likelihood: (language, word), in logs."""
    texts, kinds = len(first) - 1, len(likelihood)
    best, share = np.full(texts, -1), np.zeros(texts)
    there = np.flatnonzero(np.diff(first))
    if not len(there) or not kinds:
        return best, share
    count = np.diff(first)[there]
    top = likelihood.max(axis=0)
    p = np.exp(np.maximum(likelihood - top, -60))

    def em(p, begin, count, allowed):
        """Shares (language, text), and the log-likelihood beyond the words' best."""
        pi = allowed / allowed.sum(axis=0)
        for step in range(STEPS + 1):
            each = [x * np.repeat(y, count) for x, y in zip(p, pi, strict=True)]
            total = np.maximum(sum(each), 1e-30)
            if step == STEPS:
                return pi, np.add.reduceat(np.log(total), begin)
            pi = np.stack([np.add.reduceat(x / total, begin) / count for x in each])

    begin = first[there]
    n = count.astype(float)
    price = PENALTY * np.log(np.maximum(n, 2)) / 2
    pi, most = em(p, begin, count, np.ones((kinds, len(there)), np.float32))
    order = np.argsort(-pi, axis=0, kind="stable")
    single = np.stack([np.add.reduceat(np.log(np.maximum(x, 1e-30)), begin) for x in p])
    value = np.take_along_axis(single, order[:1], axis=0)[0]
    best[there], share[there] = order[0], 1.0
    # the full set's likelihood bounds that of any set: most texts are settled here,
    # and a text tries no set whose price is above that bound
    for size in range(2, kinds + 1):
        left = np.flatnonzero(most - price * (size - 1) > value)
        if not len(left):
            break
        words = np.repeat(np.isin(np.arange(len(there)), left), count)
        begin = np.cumsum(count[left]) - count[left]
        allowed = np.zeros((kinds, len(left)), np.float32)
        np.put_along_axis(allowed, order[:size, left], 1.0, axis=0)
        pi, fits = em([x[words] for x in p], begin, count[left], allowed)
        fits = fits - price[left] * (size - 1)
        better = fits > value[left]
        value[left[better]] = fits[better]
        best[there[left[better]]] = pi[:, better].argmax(axis=0)
        share[there[left[better]]] = pi[:, better].max(axis=0)
    return best, share


def languages(docs: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang).

    Learns from text and non-null lang of the rows outside the held-out fold
    (a bounded sample); only text is an input of a prediction. Null text, or
    none of its characters a letter, or nothing to learn from: 'und', score 0.
    The score is the language's share times that of the words which the mixture
    explains better than chance, so text in no learned script still gets a learned
    language, with a score near 0. A set may hold any number of languages. Repeated rows give repeated results; an empty table gives no rows.
    """
    kinds, table = fit(docs, bound)
    shared = docs.sparkSession.sparkContext.broadcast((kinds, table))

    def run(batches):
        names, logs = shared.value
        for batch in batches:
            pred, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, buf, off in chunks(batch.column(1), 1 << 18):
                first, begin, slot = word_trigrams(buf, off)
                if not len(slot) or not names:
                    continue
                likelihood = np.ascontiguousarray(np.add.reduceat(logs[slot], begin, axis=0).T)
                best, share = mixtures(likelihood, first)
                chance = np.diff(np.r_[begin, len(slot)]) * np.log(1 / (1 << TABLE_BITS))
                told = np.r_[0, np.cumsum(likelihood.max(axis=0) > chance)]
                share = share * (told[first[1:]] - told[first[:-1]]) / np.maximum(np.diff(first), 1)
                for i in np.flatnonzero((best >= 0) & letters[lo:hi]):
                    pred[lo + i], score[lo + i] = names[best[i]], share[i]
            bare = np.flatnonzero(letters & (pred == "und")) if names else []
            for i in bare:
                pred[i], score[i] = names[0], 1 / len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(pred.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), (fold("doc_id", 3) == 1).alias("held_out"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))
