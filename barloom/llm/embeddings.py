"""Embedding near-duplicates by product quantisation.

Coarse centroids and residual codebooks come from a bounded sample; every vector
is coded in the inverted list of its nearest centroid. Every vector is also a
query: it probes its nearest lists, sums asymmetric distances from one lookup
table per subspace, keeps a code whose distance less its own coding error is
within the radius (so coding loses nothing), and the kept pairs are compared by
exact cosine in double precision. Lists fall into blocks of bounded size, and a
task meets one block of codes with one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint, components, doc_key, read
from .simhash import Forest

COSINE = 0.9
#: Rows that the fit sees, about; vectors of a list, aimed at; most lists.
SAMPLE_ROWS = 8192
LIST_ROWS = 200
MOST_LISTS = 4096
SUBSPACES, WORDS = 8, 64
PROBES = 8
CODE_BLOCK, QUERY_BLOCK = 1024, 4096


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first."""
    far = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    n = min(n, len(centres))
    part = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(far, part, axis=1), axis=1, kind="stable"), axis=1)


def k_means(x: np.ndarray, k: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = nearest(x, centres, 1)[:, 0]
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec): distinct vectors with a direction, as double arrays; id is the
    smallest vec_id, copies the number of rows. Null, zero, null or non-finite
    components: no row."""
    vec = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vec", lambda v: v != 0)
    known = vectors.select(doc_key("vec_id").alias("id"), vec.alias("vec")).where("vec is not null").where(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    return known.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def unit(rows) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # very large or small components square safely
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def fit(known: DataFrame, there: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centres and codebooks (subspace, word, part) from a bounded sample."""
    rows = known if there <= SAMPLE_ROWS else known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(SAMPLE_ROWS / there * (1 << 30)))
    sample = rows.select("id", "vec").orderBy("id").toArrow()
    if not len(sample):  # the hash chose none of a few rows
        sample = known.select("id", "vec").orderBy("id").limit(SAMPLE_ROWS).toArrow()
    x = unit(sample.column("vec").combine_chunks())
    centres = k_means(x, max(1, min(MOST_LISTS, there // LIST_ROWS, len(x) // 4)))
    rest = x - centres[nearest(x, centres, 1)[:, 0]]
    return centres, np.stack([_padded(k_means(part, WORDS)) for part in np.array_split(_even(rest), SUBSPACES, axis=1)])


def _even(x: np.ndarray) -> np.ndarray:
    """Columns of zeros at the end, so that the subspaces are equally wide."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))


def _padded(words: np.ndarray) -> np.ndarray:
    return np.vstack([words, np.repeat(words[:1], WORDS - len(words), axis=0)])


def coded(known: DataFrame, model) -> DataFrame:
    """(id, copies, vec, list, probes, code, error) of each vector: its list, the
    lists that it probes, its residual's code and the code's error."""
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        centres, books = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = unit(batch.column(2))
            probes = nearest(x, centres, PROBES)
            rest = _even(x - centres[probes[:, 0]]).reshape(len(x), SUBSPACES, -1)
            code = np.stack([nearest(rest[:, m], books[m], 1)[:, 0] for m in range(SUBSPACES)], axis=1)
            error = np.sqrt(((rest - books[np.arange(SUBSPACES), code]) ** 2).sum(axis=(1, 2)))
            wide = pa.array(np.arange(len(x) + 1, dtype=np.int32) * probes.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(probes[:, 0].astype(np.int32)), pa.ListArray.from_arrays(wide, pa.array(probes.astype(np.int32).ravel())), pa.array([r.tobytes() for r in code.astype(np.uint8)]), pa.array(error)], names=["id", "copies", "vec", "list", "probes", "code", "error"])

    return known.select("id", "copies", "vec").mapInArrow(run, "id long, copies long, vec array<double>, list int, probes array<int>, code binary, error double")


def link_block(table: pa.Table, model, cosine: float) -> pa.Table:
    """One block of codes against one block of queries: (a, b, n): links a-b of a
    spanning forest, and (a, null, n) rows that add n links to a."""
    centres, books = model
    table = table.combine_chunks()
    role = table.column("role").to_numpy()
    codes, queries = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
    ends: tuple[list, list] = ([], [])
    found_a, found_b, weight_a, weight_b = [], [], [], []
    if len(codes) and len(queries):
        here = int(table.column("list")[0].as_py())
        own = {c: codes.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "error")}
        ask = {c: queries.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "home")}
        x, q = unit(codes.column("vec").combine_chunks()), unit(queries.column("vec").combine_chunks())
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(codes), SUBSPACES)
        probes = codes.column("probes").combine_chunks()
        probes = probes.flatten().to_numpy().reshape(len(codes), -1)
        reach = (np.sqrt(max(0.0, 2 - 2 * cosine)) + own["error"] + 1e-6) ** 2
        for lo in range(0, len(q), 256):
            part = _even(q[lo : lo + 256] - centres[here]).reshape(-1, SUBSPACES, 1, books.shape[2])
            lookup = ((part - books) ** 2).sum(axis=3)  # (query, subspace, word)
            far = sum(lookup[:, m, code[:, m]] for m in range(SUBSPACES))
            i, j = np.nonzero(far <= reach)
            i = i + lo
            keep = own["id"][j] != ask["id"][i]
            i, j = i[keep], j[keep]
            exact = np.einsum("nd,nd->n", q[i], x[j]) >= cosine
            i, j = i[exact], j[exact]
            # the other way round it is found too if the code's vector probes the query's list
            both = (probes[j] == ask["home"][i][:, None]).any(axis=1)
            once = ~both | (ask["id"][i] < own["id"][j])
            i, j = i[once], j[once]
            found_a.append(ask["id"][i])
            found_b.append(own["id"][j])
            weight_a.append(own["copies"][j])
            weight_b.append(ask["copies"][i])
    if found_a and len(a := np.concatenate(found_a)):
        b, wa, wb = np.concatenate(found_b), np.concatenate(weight_a), np.concatenate(weight_b)
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(ids))
        for u, v in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            if forest.find(u) != forest.find(v):
                forest.join(u, v)
                ends[0].append(ids[u])
                ends[1].append(ids[v])
        n = np.bincount(at, np.r_[wa, wb]).astype(np.int64)
    else:
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.r_[np.array(ends[0], np.int64), ids]), "b": pa.array([*map(int, ends[1]), *[None] * len(ids)], pa.int64()), "n": pa.array(np.r_[np.zeros(len(ends[0]), np.int64), n])})


def linked(same: DataFrame, there: int, cosine: float) -> DataFrame:
    """(a, b, n) of link_block for vectors of one length."""
    model = fit(same, there)
    index = checkpoint(coded(same, model))
    lists = index.groupBy(F.col("list").alias("l")).agg(F.ceil(F.count("*") / CODE_BLOCK).cast("int").alias("code_blocks"))
    asked = index.select(F.explode("probes").alias("q")).groupBy("q").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks"))
    blocks = checkpoint(lists.join(asked, F.col("l") == F.col("q")).select("l", "code_blocks", "query_blocks"))  # one row a list, MOST_LISTS at most
    code = index.select(F.lit(0).alias("role"), "list", F.col("list").alias("home"), "id", "copies", "vec", "probes", "code", "error")
    query = index.select(F.lit(1).alias("role"), F.explode("probes").alias("list"), F.col("list").alias("home"), "id", "copies", "vec", F.lit(None).cast("array<int>").alias("probes"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    dealt = code.union(query).join(F.broadcast(blocks), F.col("list") == F.col("l"))
    is_code = F.col("role") == 0
    mine = F.when(is_code, F.pmod(F.xxhash64("id"), F.col("code_blocks"))).otherwise(F.pmod(F.xxhash64("id"), F.col("query_blocks"))).cast("int")
    others = F.when(is_code, F.col("query_blocks")).otherwise(F.col("code_blocks"))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.withColumn("block", F.when(is_code, F.struct(F.col("mine").alias("c"), F.col("other").alias("q"))).otherwise(F.struct(F.col("other").alias("c"), F.col("mine").alias("q"))))
    shared = same.sparkSession.sparkContext.broadcast(model)
    dealt = dealt.select("role", "list", "home", "id", "copies", "vec", "probes", "code", "error", F.col("block.c").alias("c"), F.col("block.q").alias("q"))
    return checkpoint(dealt.groupBy("list", "c", "q").applyInArrow(lambda t: link_block(t, shared.value, cosine), "a long, b long, n long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    Rows without a usable vector (null, zero, null or non-finite components) link with
    nothing; vectors of different length never link. Equal vectors link with each
    other. Found links have a cosine of `cosine` or more; lists that a vector
    does not probe may hide some. Repeated rows count as rows of their own; an
    empty table gives no rows.
    """
    known = checkpoint(usable(vectors))
    ids = vectors.select("vec_id", F.transform(F.col("embedding"), lambda v: v.cast("double")).alias("vec"))
    found = None
    for row in known.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n")).orderBy("length").collect():  # each length is an index of its own
        part = linked(known.where(F.size("vec") == row["length"]), row["n"], cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    groups = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("counted")).agg(F.sum("n").alias("n"))
    named = known.join(groups, "id", "left").join(counts, F.col("id") == F.col("counted"), "left")
    named = named.select(F.col("vec").alias("own"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = ids.join(named, F.col("vec") == F.col("own"), "left")
    component = F.coalesce("component_id", doc_key("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (doc_key("vec_id") == component).alias("kept"))


def op6(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP6_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
good as (select vec_id, e from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x != 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id != b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select vec_id as id, vec_id as other from embeddings union select r.id, l.b from reach r join links l on l.a = r.other)
select e.vec_id, (select count(*) from links where a = e.vec_id)::bigint as n_links, c.component as component_id, e.vec_id = c.component as kept
from embeddings e join (select id, min(other)::bigint as component from reach group by id) c on c.id = e.vec_id"""
