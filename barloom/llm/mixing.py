"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is taken floor(target / size) times; whether once
more is a balanced sample with the remaining fraction as inclusion probability.
Flight: within blocks of bounded size the probabilities move through the
null space of the balancing constraints (tokens and documents), three documents
at a time, until two at most are left undecided; what is left over from the
blocks flies again in fewer blocks, until one block of a source remains.
Large documents are decided first. Landing: the last two documents are settled by
the choice that is nearest to the token target, and what is missing then is made good
by single documents.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, checkpoint, doc_key, quoted, read, text_key, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK = 4096
#: Rows of one repeated document that one step writes; salts of a very frequent one.
RUN = 65_536
SALTS = 64


def sizes(docs: DataFrame) -> DataFrame:
    """(key, x, source, size): text hash, and words of each whole text, null text 0."""
    return docs.select(doc_key().alias("key"), text_key().alias("x"), "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): shares of all sizes by weight, none above
    `limit` times its source's size; the excess goes to the others by weight.

    Closed form over one row per source: in order of limit / weight, a source
    is at its limit if the level that the others would then need is above it.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("weight", F.element_at(table, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    by = by.withColumn("before", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("open"))
    by = by.withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("most") / F.col("weight")).alias("at"), "level"))).over(whole)["level"]
    return by.select("source", "source_size", F.coalesce(F.least("most", level * F.col("weight")), F.col("most")).alias("target"))


TINY = 1e-9


def flight(chance: list[float], size: list[float]) -> None:
    """Move chances until two at most lie strictly between 0 and 1, keeping their
    sum and their sum weighted by size (in place). Sizes descend.

    The two largest undecided documents fly with the smallest one, and the largest moves
    to its nearer end: neighbours in size pay for each other, the smallest keeps the
    count, and large documents are decided first."""
    for k, c in enumerate(chance):
        if not TINY < c < 1 - TINY:
            chance[k] = float(c >= 0.5)
    left = deque(k for k, c in enumerate(chance) if 0 < c < 1)
    while len(left) > 2:
        i, j, m = left[0], left[1], left[-1]
        u = (size[m] - size[j], size[i] - size[m], size[j] - size[i])  # sums of u and of u * size are 0
        if not any(u):
            u = (1.0, -1.0, 0.0)
        if (u[0] > 0) != (chance[i] >= 0.5):
            u = (-u[0], -u[1], -u[2])
        step = min(((1 - chance[x]) / d if d > 0 else chance[x] / -d) for x, d in zip((i, j, m), u, strict=True) if d)
        for x, d in zip((i, j, m), u, strict=True):
            chance[x] += step * d
            if not TINY < chance[x] < 1 - TINY:
                chance[x] = float(chance[x] >= 0.5)
        left.popleft()
        left.popleft()
        if 0 < chance[j] < 1:
            left.appendleft(j)
        if 0 < chance[i] < 1:
            left.appendleft(i)
        if not 0 < chance[m] < 1:
            left.pop()


def land(chance: list[float], size: list[float]) -> None:
    """Settle the last undecided documents by the choice nearest to the token sum, then
    to the document sum; what is then missing or over is made good by single documents,
    each the largest that brings the sum nearer."""
    left = [k for k, c in enumerate(chance) if 0 < c < 1]
    tokens, count = sum(chance[k] * size[k] for k in left), sum(chance[k] for k in left)
    best = min(range(1 << len(left)), key=lambda s: (abs(sum(size[k] for b, k in enumerate(left) if s >> b & 1) - tokens), abs(bin(s).count("1") - count), s))
    for b, k in enumerate(left):
        chance[k] = float(best >> b & 1)
        tokens -= chance[k] * size[k]
    for k, s in enumerate(size):  # sizes descend
        change = s if chance[k] == 0 else -s
        if k not in left and abs(tokens - change) < abs(tokens) and tokens * change > 0:
            chance[k], tokens = 1 - chance[k], tokens - change


def balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, key, x, size, chance) with chances 0 or 1, from chances between: the
    sums of chance and of chance * size stay as near as one document allows in
    every source. A source's documents are dealt to blocks by a hash."""
    kind = "source string, key long, x long, size long, chance double, part long, last boolean"

    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "key", "x"], ascending=[False, True, True, True], kind="stable")
        chance, size = rows["chance"].tolist(), rows["size"].astype(float).tolist()
        flight(chance, size)
        if rows["last"].iloc[0]:
            land(chance, size)
        return rows.assign(chance=chance)[["source", "key", "x", "size", "chance", "part", "last"]]

    done, open_, round_ = [], units, 0
    while True:
        many = open_.groupBy(F.col("source").alias("own")).agg(F.ceil(F.count("*") / block).alias("parts"))
        dealt = open_.join(many, F.col("source").eqNullSafe(F.col("own"))).drop("own")
        dealt = dealt.select("source", "key", "x", "size", "chance", F.pmod(F.xxhash64("key", "x", F.lit(round_)), F.col("parts")).alias("part"), (F.col("parts") == 1).alias("last"), F.xxhash64("key", "x").alias("order"))
        flown = checkpoint(dealt.groupBy("source", "part").applyInPandas(fly, kind))
        done.append(flown.where("chance in (0, 1)").select("source", "key", "x", "size", "chance"))
        open_ = flown.where("chance not in (0, 1)").select("source", "key", "x", "size", "chance")
        if open_.isEmpty():
            break
        round_ += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document.

    taken is size times the copies that the mix takes, never above `limit`
    times size; each source's taken words come within a small document of its
    target, where the source's documents allow it. Null text has size 0; a null source is a source, the last in order.
    Rows that repeat a doc_id, source and text are drawn each by itself: of n such
    rows, as many are taken once more as their chances add up to. A null doc_id
    stays null. An empty table gives no rows. Reruns agree: the order of the flight
    is a hash of ids and texts.
    """
    each = mixed(docs, weights, limit, block)
    many = F.ceil(F.col("n") / RUN).cast("long")
    runs = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    long, short = runs.where(F.col("n") > RUN), runs.where(F.col("n") <= RUN)
    runs = short.union(long.repartition("doc_id", "x", "part"))  # rows of a frequent document come from several tasks
    last = F.least(F.col("n"), (F.col("part") + 1) * RUN)
    rows = runs.withColumn("at", F.explode(F.sequence(F.col("part") * RUN + 1, last)))
    copies = F.col("base") + (F.col("at") <= F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """(source, key, x, doc_id, size, n, source_size, target, base, extra) of each
    distinct document: n rows repeat it; each is taken base times, extra of them
    once more. What n chances add up to beyond whole rows is one chance, drawn with
    those of the other documents."""
    known = checkpoint(sizes(docs).groupBy("source", "key", "x", "doc_id", "size").agg(F.count("*").alias("n")))
    aims = targets(known.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit).select(F.col("source").alias("own"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = known.join(aims, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    joined = joined.withColumn("base", F.floor(ratio + 1e-12)).withColumn("share", F.when(F.col("size") > 0, F.col("n") * F.greatest(ratio - F.col("base"), F.lit(0.0))).otherwise(0.0))
    joined = joined.withColumn("sure", F.floor(F.col("share") + 1e-9)).withColumn("chance", F.greatest(F.col("share") - F.col("sure"), F.lit(0.0)))
    drawn = balanced(joined.where("chance > 0").select("source", "key", "x", "size", "chance"), block).where("chance = 1")
    drawn = drawn.select(F.col("source").alias("s2"), F.col("key").alias("k2"), F.col("x").alias("x2"))
    same = (F.col("key") == F.col("k2")) & F.col("source").eqNullSafe(F.col("s2")) & (F.col("x") == F.col("x2"))
    extra = F.least(F.col("sure") + F.col("k2").isNotNull().cast("long"), F.col("n"))
    return joined.join(drawn, same, "left").select("source", "key", "x", "doc_id", "size", "n", "source_size", "target", "base", extra.alias("extra"))


def _hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row; those that hold maps count as JSON."""
    plain = lambda n, kind: F.to_json(F.struct(quoted(n))) if "map<" in kind or "variant" in kind else quoted(n)
    return F.xxhash64(*[plain(n, kind) for n, kind in docs.dtypes])


def take_mix(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """docs with a column copies added: how often the mix takes the row (0 rows stay out).

    Of rows that repeat a document some may be taken once more than the others: the
    first in order of a hash of the whole row, so the result does not depend on how
    rows are dealt; equal rows are interchangeable. A row that comes over RUN times is
    counted first and written out again in runs. Null ids and texts and empty tables
    behave as in mix_sources; a column copies is replaced, other names may clash.
    """
    docs = docs.drop("copies")
    unit = ["mix_key", "mix_x", "mix_source"]
    wrapped = docs.select(doc_key().alias("mix_key"), text_key().alias("mix_x"), F.col("source").cast("string").alias("mix_source"), _hash(docs).alias("mix_row"), whole_row(docs).alias("row"))
    taken = mixed(docs, weights, limit).where("size > 0 and base + extra > 0").select(F.col("key").alias("k"), F.col("x").alias("x"), F.col("source").alias("s"), "base", "extra")
    taken = checkpoint(taken)
    rows = wrapped.groupBy(*unit, "mix_row").agg(F.count("*").alias("m"))
    rows = rows.join(taken, (F.col("mix_key") == F.col("k")) & (F.col("mix_x") == F.col("x")) & F.col("mix_source").eqNullSafe(F.col("s"))).drop("k", "x", "s")
    rows = rows.withColumn("salt", F.pmod("mix_row", F.lit(SALTS)))
    before = Window.partitionBy(*unit).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = rows.groupBy(*unit, "salt").agg(F.sum("m").alias("m")).withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    salts = salts.select(*[F.col(c).alias(f"s_{c}") for c in unit], F.col("salt").alias("s_salt"), "offset")
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*unit, "salt")]
    inside = Window.partitionBy(*unit, "salt").orderBy("mix_row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("first", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(salts, same[0] & same[1] & same[2] & same[3])
    more = F.greatest(F.lit(0).cast("long"), F.least(F.col("m"), F.col("extra") - F.col("offset") - F.col("first")))
    ranked = checkpoint(ranked.withColumn("more", more).where("base + more > 0").select(*[F.col(c).alias(f"r_{c}") for c in (*unit, "mix_row")], "m", "base", "more"))
    equal = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in (*unit, "mix_row")]
    equal = equal[0] & equal[1] & equal[2] & equal[3]
    short, long = ranked.where(F.col("m") <= RUN), ranked.where(F.col("m") > RUN)
    names = [F.col("row")[n].alias(n) for n in docs.columns]
    at = F.row_number().over(Window.partitionBy(*unit, "mix_row").orderBy("mix_row"))
    out = wrapped.join(short, equal).withColumn("at", at)
    copies = (F.col("base") + (F.col("at") <= F.col("more")).cast("long")).cast("int").alias("copies")
    out = out.select(*names, copies)
    if not long.isEmpty():
        one = wrapped.join(F.broadcast(long), equal).groupBy(*unit, "mix_row", "m", "base", "more").agg(F.first("row").alias("row"))  # a row each of RUN rows at most
        runs = one.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN)))).repartition(*unit, "run")
        runs = runs.withColumn("at", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("m"), (F.col("run") + 1) * RUN))))
        out = out.unionByName(runs.select(*names, copies))
    return out.where("copies > 0")


def op8(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
