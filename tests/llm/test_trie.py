"""The prefix trie against a plain walk over all conversations, and the double array itself."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from barloom.llm import common, trie

KIND = "conv_id long, turn long, role string, text string, key string, block long, n long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), 75, 101, 103, 250, 1004, -1, -5, -7, -250]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"t{t} é{rng.randrange(2)}" if t < 4 else f"{c} {t}"))
    rows += [(c, t, "user", f"hot {t}") for c in range(2000, 2400) for t in range(3)]  # one common conversation
    rows += [(3000, None, "user", "first"), (3000, 0, None, None), (3000, 2, "a", ""), (3000, 2, "a", ""), (3000, 2, "a", "")]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    rows += [(3004, t, "user", f"long {t}") for t in range(300)]  # longer than a shard
    rng.shuffle(rows)
    return rows


def by_hand(rows, rebuild):
    own: dict = {}
    for c, t, role, text in rows:
        own.setdefault(common.NO_ID if c is None else c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        whole[c] = tuple((own.get(base, [])[:h] if rebuild else []) + turns[h:])
    members: dict = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), len(kids.get(p, [])), sum(q not in kids for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_turns, broadcast_rows", [(trie.SHARD_TURNS, trie.BROADCAST_ROWS), (40, 0)])
def test_nodes_equal_a_plain_walk(spark, shard_turns, broadcast_rows):
    rows = conversations()
    table = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], KIND)
    for paths, rebuild in ((trie.paths, False), (trie.rebuilt_paths, True)):
        got = collected(trie.prefix_trie(paths(table), len(rows), shard_turns, broadcast_rows))
        assert got == by_hand(rows, rebuild)


def test_empty_table_and_turnless_conversations(spark):
    assert collected(trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame([], KIND)), 0)) == []
    few = next([(c, 0, "u", "x")] for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    got = collected(trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame([(*r, "", 0, 0) for r in few], KIND)), 1))
    assert got == by_hand(few, True) and len(got) == 1 and got[0][1] == 0


def test_a_double_array_holds_exactly_its_sequences():
    rng = random.Random(1)
    held = sorted({tuple(rng.randrange(30) for _ in range(rng.randrange(6))) for _ in range(800)})
    start = np.cumsum([0, *map(len, held)])
    ids = np.array([x for s in held for x in s])
    shared = np.array([0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(held, held[1:], strict=False)])
    array = trie.DoubleArray(ids, start, shared)
    assert (array.check >= 0).sum() == len({s[:d] for s in held for d in range(1, len(s) + 1)})
    after, last = array.walk(ids, start)
    assert len(set(last.tolist())) == len(held)
    assert len(array.check) < 1.5 * len(set(after.tolist())) + 30
    with pytest.raises((ValueError, IndexError)):
        array.walk(np.array([29, 29, 29, 29, 29, 29, 29]), np.array([0, 7]))


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = duck.sql(trie.OP11_SQL)
    assert want.columns == NAMES
    assert collected(trie.op11(spark, "/root/testdata/sf0.01")) == sorted(want.fetchall(), key=str)
