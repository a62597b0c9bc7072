"""Conversation prefix trie over double arrays.

A turn is a code of 20 bytes (digest and length of its text), a conversation the
codes of its turns, one after the other. Ranges of conversations in code order are
the prefix shards: any two shards share nodes only along the path between them, so a
prefix that a third of all conversations start with is cut into many shards. Each
shard packs BASE and CHECK over its own dense turn ids and traverses them for nodes.
Nodes on the first and the last path of a shard (the upper nodes) may be shared;
their aggregates are merged by key, their subtree sums by doubling ancestors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import NO_ID, checkpoint, read

#: Bytes of a turn's code: a digest, then the length of the text in bytes.
DIGEST, CODE = 16, 20
#: Turns of a shard (a longer conversation is a shard of its own), and rows of a batch.
SHARD_TURNS = 1 << 18
BATCH = 1 << 16
#: Ids of a block of conversations have these low bits free; heads have 8 turns at most.
BLOCK_BITS, HEAD = 8, 8
#: Upper nodes up to which their table is broadcast; salts of a join with them beyond.
BROADCAST_ROWS, SALTS = 100_000, 32
#: Slots that are tried for a node with several children before it goes to the end.
TRIES = 64
NOTHING = hashlib.sha256(b"").hexdigest()


def _code(role: Column, text: Column) -> Column:
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 2 * (CODE - DIGEST), "0")))


def coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, code) of each row; texts stay behind."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    return rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), _code(role, text).alias("code"))


def _codes(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.hex(t["code"]))


def _path(codes: Column) -> Column:
    return F.unhex(F.array_join(codes, ""))


def _grouped(rows: DataFrame, base: Column) -> DataFrame:
    """(block, base, turns in order) of the conversations with one base."""
    known = coded(rows).withColumn("base", base).withColumn("block", F.shiftright("base", BLOCK_BITS))
    turn = F.struct("conv", "turn", "role", "code")
    return known.repartition("block").groupBy("block", "base").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def paths(rows: DataFrame) -> DataFrame:
    """(block, conv, path) of the conversations as they are."""
    return _grouped(rows, F.col("conv")).select("block", F.col("base").alias("conv"), _path(_codes(F.col("turns"))).alias("path"))


def rebuilt_paths(rows: DataFrame) -> DataFrame:
    """(block, conv, path) with the first h turns taken from conversation c - c % 5,
    h = crc32 of the decimal c, modulo 9."""
    group = _grouped(rows, F.col("conv") - F.col("conv") % 5)
    head = F.slice(F.filter("turns", lambda t: t["conv"] == F.col("base")), 1, HEAD)
    group = group.withColumn("head", _codes(head))
    each = group.select("block", "head", "turns", F.explode(F.array_distinct(F.transform("turns", lambda t: t["conv"]))).alias("conv"))
    each = each.withColumn("own", _codes(F.filter("turns", lambda t: t["conv"] == F.col("conv")))).drop("turns")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)).cast("int")
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return each.select("block", "conv", _path(F.concat(F.slice("head", F.lit(1), h), rest)).alias("path"))


class DoubleArray:
    """BASE and CHECK over dense ids of sorted, distinct sequences. State 0 is the
    root; the child of s under id c is BASE[s] + c where CHECK of that place is s."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, common: np.ndarray):
        """Sequence k is ids[start[k]:start[k + 1]] and shares common[k] ids with the one before."""
        self.base, self.check = [0], [-1]
        self.holes: list[int] = []
        flat, at, shared = ids.tolist(), start.tolist(), common.tolist()
        todo = [(0, 0, len(start) - 1, 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and at[lo + 1] - at[lo] == depth:
                lo += 1  # ends here; shorter sequences come first
            while hi - lo == 1 and at[lo] + depth < at[hi]:  # one sequence is left: a chain
                state, depth = self._place(state, [flat[at[lo] + depth]])[0], depth + 1
            if hi - lo < 2:
                continue
            cuts = [lo, *(k for k in range(lo + 1, hi) if shared[k] == depth), hi]
            children = self._place(state, [flat[at[k] + depth] for k in cuts[:-1]])
            todo += [(t, a, b, depth + 1) for t, a, b in zip(children, cuts, cuts[1:], strict=False)]
        self.base, self.check = np.array(self.base), np.array(self.check)

    def _place(self, state: int, labels: list[int]) -> list[int]:
        check, first = self.check, min(labels)
        while self.holes and check[self.holes[-1]] != -2:
            self.holes.pop()
        base = len(check) - first
        if len(labels) == 1 and self.holes:
            base = self.holes.pop() - first
        elif len(labels) > 1:
            for hole in reversed(self.holes[-TRIES:]):
                if all(hole - first + c >= len(check) or check[hole - first + c] == -2 for c in labels):
                    base = hole - first
                    break
        grown = base + max(labels) + 1 - len(check)
        if grown > 0:
            self.holes.extend(range(len(check), len(check) + grown))
            check.extend([-2] * grown)
            self.base.extend([0] * grown)
        self.base[state] = base
        for c in labels:
            check[base + c] = state
        return [base + c for c in labels]

    def walk(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each id of each sequence, and the state each one ends in."""
        length = np.diff(start)
        state, after = np.zeros(len(length), np.int64), np.zeros(len(ids), np.int64)
        alive = np.flatnonzero(length > 0)
        for depth in range(int(length.max(initial=0))):
            alive = alive[length[alive] > depth]
            at = start[alive] + depth
            to = self.base[state[alive]] + ids[at]
            if (self.check[to] != state[alive]).any():
                raise ValueError("a sequence leaves the trie")
            state[alive] = after[at] = to
        return after, state


def _dense(codes: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ids of the codes, numbered by depth and then by sequence, so that
    siblings lie side by side; and for each sequence the ids it shares with the one before."""
    length = np.diff(start)
    depth = np.arange(len(codes)) - np.repeat(start[:-1], length)
    order = np.lexsort((np.repeat(np.arange(len(length)), length), depth))
    _, first, inverse = np.unique(codes[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    ids = np.empty(len(codes), np.int64)
    ids[order] = rank[inverse]
    shared = np.zeros(len(length), np.int64)
    for k in range(1, len(length)):
        n = min(length[k], length[k - 1])
        differ = np.flatnonzero(ids[start[k] : start[k] + n] != ids[start[k - 1] : start[k - 1] + n])
        shared[k] = differ[0] if len(differ) else n
    return ids, shared


NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n long, kids long, leaves long, saved long, size long, ends string"
_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _keys(path: bytes) -> list[bytes]:
    """The key of each prefix of a path, the root's first."""
    running = hashlib.blake2b(digest_size=DIGEST)
    out = [running.digest()]
    for k in range(0, len(path), CODE):
        running.update(path[k : k + CODE])
        out.append(running.digest())
    return out


def shard_nodes(whole: list[bytes], members: list[int], first: list[int], ends: list[str]):
    """Record batches of the nodes of one shard: sorted distinct paths, with members,
    smallest member and ends digest of each.

    Upper nodes have a key and carry what is theirs apart from other upper nodes;
    the others are final, but for the parent's conv_id where the parent is upper.
    """
    start = np.cumsum([0, *(len(p) // CODE for p in whole)])
    codes = np.frombuffer(b"".join(whole), f"S{CODE}")
    sizes = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, CODE)[:, DIGEST:].astype(np.int64) @ (256 ** np.arange(CODE - DIGEST - 1, -1, -1))
    ids, shared = _dense(codes, start)
    trie = DoubleArray(ids, start, shared)
    after, last = trie.walk(ids, start)
    places = len(trie.check)
    depth, size, told = np.full(places, -1, np.int64), np.zeros(places, np.int64), np.full(places, -1, np.int64)
    depth[0], depth[after] = 0, np.arange(len(ids)) - np.repeat(start[:-1], np.diff(start)) + 1
    size[after], told[last] = sizes, np.arange(len(whole))
    n, least = np.zeros(places, np.int64), np.full(places, NO_ID, np.int64)
    n[last], least[last] = members, first
    states = np.flatnonzero(depth >= 0)
    states = states[np.argsort(depth[states], kind="stable")]
    bounds = np.searchsorted(depth[states], np.arange(int(depth.max()) + 2))
    levels = [states[a:b] for a, b in zip(bounds[1:-1], bounds[2:], strict=True)]  # below the root
    for level in reversed(levels):
        np.add.at(n, trie.check[level], n[level])
        np.minimum.at(least, trie.check[level], least[level])
    upper = np.zeros(places, bool)
    keys: dict[int, tuple[bytes, bytes | None]] = {}
    for k in {0, len(whole) - 1}:
        trail, names = [0, *after[start[k] : start[k + 1]].tolist()], _keys(whole[k])
        upper[trail] = True
        keys |= dict(zip(trail, zip(names, [None, *names[:-1]], strict=True), strict=True))
    kids = np.bincount(trie.check[states[1:]], minlength=places)
    leaves, saved = (kids == 0).astype(np.int64), (n - 1) * size
    leaves[upper] = saved[upper] = kids[upper] = 0
    for level in reversed(levels):
        own = level[~upper[level]]
        up = trie.check[own]
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])
        np.add.at(kids, up[upper[up]], 1)
    above = np.where(states > 0, trie.check[states], 0)
    open_ = upper[above] & (states > 0)
    key = [keys[s][0] if u else None for s, u in zip(states.tolist(), upper[states].tolist(), strict=True)]
    parent_key = [keys[p][0] if o else None for p, o in zip(above.tolist(), open_.tolist(), strict=True)]
    mine = [ends[k] if k >= 0 else NOTHING for k in told[states].tolist()]
    columns = [key, parent_key, depth[states], least[states], least[above], n[states], kids[states], leaves[states], saved[states], size[states], mine]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)], _NAMES)
    yield from table.to_batches(max_chunksize=BATCH)


def _shards(limit: int):
    """Batches of rows (path, n, first, ids) sorted by path and block, to nodes."""

    def run(batches):
        whole, members, first, ends, turns, running = [], [], [], [], 0, None
        for batch in batches:
            for path, n, low, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole and path == whole[-1]:
                    running.update(b"," + ids.encode())
                    members[-1] += n
                    first[-1] = min(first[-1], low)
                    continue
                if whole:
                    ends.append(running.hexdigest())
                    if turns >= limit:
                        yield from shard_nodes(whole, members, first, ends)
                        whole, members, first, ends, turns = [], [], [], [], 0
                running = hashlib.sha256(ids.encode())
                whole.append(path)
                members.append(n)
                first.append(low)
                turns += len(path) // CODE + 1
        if whole:
            ends.append(running.hexdigest())
            yield from shard_nodes(whole, members, first, ends)

    return run


def _merged(nodes: DataFrame) -> DataFrame:
    """(key, parent_key, depth, conv_id, n, kids, leaves, saved, ends) of the upper
    nodes, whole: partial aggregates by key, then sums over subtrees by ancestors at
    distances 1, 2, 4 and so on."""
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")]
    ends = F.coalesce(F.max(F.when(F.col("ends") != NOTHING, F.col("ends"))), F.lit(NOTHING)).alias("ends")
    own = nodes.where("key is not null").groupBy("key", "parent_key", "depth", "size").agg(F.min("conv_id").alias("conv_id"), *sums, ends)
    own = checkpoint(own)
    below = own.groupBy(F.col("parent_key").alias("up")).agg(F.count("*").alias("more"))
    own = own.join(below, own["key"] == below["up"], "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("up", "more")
    leaves = F.col("leaves") + (F.col("kids") == 0).cast("long")
    own = checkpoint(own.withColumn("leaves", leaves).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size")))
    state = own.select("key", F.col("parent_key").alias("up"), "leaves", "saved")
    while not state.where("up is not null").isEmpty():
        heard = state.where("up is not null").groupBy(F.col("up").alias("at")).agg(F.sum("leaves").alias("l2"), F.sum("saved").alias("s2"))
        further = state.where("up is not null").select(F.col("key").alias("mid"), F.col("up").alias("next"))
        moved = state.join(heard, state["key"] == heard["at"], "left").join(further, state["up"] == further["mid"], "left")
        state = checkpoint(moved.select("key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l2", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s2", F.lit(0))).alias("saved")))
    totals = state.select(F.col("key").alias("k2"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    done = own.join(totals, own["key"] == totals["k2"]).withColumn("leaves", F.col("all_leaves")).withColumn("saved", F.col("all_saved"))
    return checkpoint(done.select("key", "parent_key", "depth", "conv_id", "n", "kids", "leaves", "saved", "ends"))


def prefix_trie(whole: DataFrame, turns: int, shard_turns: int = SHARD_TURNS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per node from paths (block, conv, path): conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` (how many there are, about) sets the number of shards. Conversations with
    equal turns are one path, pre-aggregated by block of ids before they meet; the ids
    that end at one node pass through one task in order, some hundred to a row, as
    their digest is of one string. A null conv_id is one conversation, with the
    largest long as its id; null roles and texts are empty; a null turn comes first;
    ties go by role, then by the text's digest; repeated rows are repeated turns. An
    empty table gives no rows. A conversation meets in one row, at 20 bytes a turn.
    Other columns are not read.
    """
    spark = whole.sparkSession
    ids = F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids")
    packed = whole.groupBy("block", "path").agg(F.count("*").alias("n"), F.min("conv").alias("first"), ids)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    dealt = packed.repartitionByRange(parts, "path").sortWithinPartitions("path", "block")
    nodes = checkpoint(dealt.select("path", "n", "first", "ids").mapInArrow(_shards(shard_turns), NODE))
    upper = _merged(nodes)
    names = upper.select(F.col("key").alias("up"), F.col("conv_id").alias("up_id"))
    inner = nodes.where("key is null")
    closed = inner.where("parent_key is null").select("conv_id", "depth", "parent_conv_id", "n", "kids", "leaves", "saved", "ends")
    columns = ["conv_id", "depth", F.col("up_id").alias("parent_conv_id"), "n", "kids", "leaves", "saved", "ends"]
    hanging = inner.where("parent_key is not null")
    if upper.count() <= broadcast_rows:
        hanging = hanging.join(F.broadcast(names), F.col("parent_key") == F.col("up"))
    else:  # the root alone may have a third of all nodes as children
        spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = (F.col("parent_key") == F.col("up")) & (F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)) == F.col("salt"))
        hanging = hanging.join(spread, same)
    tops = upper.join(names, F.col("parent_key") == F.col("up"), "left")
    out = closed.union(hanging.select(*columns)).union(tops.select(*columns))
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt_paths(rows), rows.count())


_CRC = """xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint)"""
OP11_SQL = f"""
with rows as (
  select coalesce(conv_id, {NO_ID}) as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
numbered as (
  select *, sha256(length(role)::varchar || ':' || role || text) as code,
    row_number() over (partition by c order by turn nulls first, role, sha256(length(role)::varchar || ':' || role || text)) as p
  from rows),
convs as (select c, ({_CRC} % 9)::bigint as h from (select distinct c from rows)),
rebuilt as (
  select v.c, 0 as part, b.p, b.code, strlen(b.text) as size from convs v join numbered b on b.c = v.c - v.c % 5 and b.p <= v.h
  union all
  select v.c, 1, o.p, o.code, strlen(o.text) from convs v join numbered o on o.c = v.c and o.p > v.h),
prefixes as (
  select c, d, size, md5(string_agg(code, '') over (partition by c order by d)) as key
  from (select *, row_number() over (partition by c order by part, p) as d from rebuilt)
  union all select c, 0, 0, 'root' from convs),
linked as (select *, lag(key) over (partition by c order by d) as up, max(d) over (partition by c) as last from prefixes),
nodes as (
  select key, d, any_value(up) as up, any_value(size) as size, min(c) as conv_id, count(*) as n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (d = last), '')) as ends
  from linked group by key, d),
kids as (select up, count(*) as n from nodes where up is not null group by up),
own as (
  select nodes.*, coalesce(kids.n, 0) as kids, (nodes.n - 1) * size as saved from nodes left join kids on kids.up = nodes.key),
trees as (
  select p.key, sum((o.kids = 0)::int) as leaves, sum(o.saved) as saved
  from own o join prefixes p on p.c = o.conv_id and p.d <= o.d group by p.key)
select o.conv_id::bigint as conv_id, o.d::bigint as depth, u.conv_id::bigint as parent_conv_id, o.n::bigint as n_convs,
  o.kids::bigint as n_children, t.leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, o.ends as ends_sha256
from own o join trees t using (key) left join own u on u.key = o.up"""
