"""Mixing by the cube method: repeated rows, null ids, and a brute-force check of the balance."""

import random
from collections import Counter

import pytest

from barloom.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, n int, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4) for i, t, s in rows], DOC)


def expected_targets(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, open_, target = sum(size.values()), set(names), {}
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            return size, {**target, **{s: level * weight[s] for s in open_}}
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over


def check(spark, rows):
    docs = frame(spark, rows)
    out = mixing.mix_sources(docs).collect()
    size, target = expected_targets(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in out)
    got, largest = Counter(), Counter()
    for r in out:
        name = next(s for s in size if size[s] == r.source_size and abs(target[s] - r.target) < 1e-6 * max(1, target[s]))
        got[name] += r.taken
        largest[name] = max(largest[name], r.size)
    for s in size:
        assert abs(got[s] - target[s]) <= largest[s]
    taken = mixing.take_mix(docs)
    assert taken.columns == [*[c for c in docs.columns if c != "copies"], "copies"]
    kept = taken.collect()
    assert len(kept) == sum(r.taken > 0 for r in out)
    assert sorted(r.copies * len(r.text.split()) for r in kept) == sorted(r.taken for r in out if r.taken)


def text(rng, n):
    return " ".join(f"w{rng.randrange(99)}" for _ in range(n))


@pytest.mark.parametrize("kind", ["null ids", "repeats", "shared ids", "one row", "empty texts"])
def test_targets_hold_with_repeated_and_null_ids(spark, kind):
    rng = random.Random(kind)
    if kind == "null ids":
        rows = [(None, text(rng, 7), rng.choice("ab")) for _ in range(1000)] + [(None, "same words here", "a")] * 500 + [(None, None, None)] * 3
    elif kind == "repeats":
        rows = [(i, text(rng, rng.randrange(1, 30)), rng.choice(["a", "b", None])) for i in range(9)] * 333
    elif kind == "shared ids":
        rows = [(i % 300, text(rng, rng.randrange(1, 9)), rng.choice("ab")) for i in range(3000)] + [(i, "twin text", s) for i in range(300) for s in "ab"]
    elif kind == "one row":
        rows = [(1, "a b c", "s")]
    else:
        rows = [(i, "", "s") for i in range(5)] + [(9, "x y", "t")]
    check(spark, rows)


def test_a_frequent_document_is_met_by_salt(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 50)
    rng = random.Random(4)
    rows = [(None, "one two three", "a")] * 900 + [(i, text(rng, 5), rng.choice("ab")) for i in range(900)]
    docs = frame(spark, rows)
    out = mixing.mix_sources(docs).collect()
    assert len(out) == 1800
    kept = mixing.take_mix(docs).collect()
    hot = [sum(r.taken for r in out if r.doc_id is None), sum(3 * r.copies for r in kept if r.doc_id is None)]
    assert abs(hot[0] - hot[1]) <= 3 * mixing.SALTS
    assert sum(r.taken for r in out if r.doc_id is not None) == sum(r.copies * len(r.text.split()) for r in kept if r.doc_id is not None)


def test_large_documents_are_decided_first():
    rng = random.Random(8)
    for _ in range(5):
        size = sorted((float(rng.randrange(1, 5000)) for _ in range(500)), reverse=True)
        chance = [0.37] * 500
        mixing.flight(chance, size)
        left = [s for c, s in zip(chance, size, strict=True) if 0 < c < 1]
        assert len(left) <= 2 and max(left, default=0) < 300


def test_sources_come_near_their_targets(spark):
    from collections import defaultdict

    taken, target = defaultdict(int), {}
    for r in mixing.op8(spark, "/root/testdata/sf0.01").collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)


def test_copies_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i % 40, f"said {i % 40} " * 3, "en", "ab"[i % 2], i // 40, 0, 0, 0) for i in range(280)] + [(None, "hot words here", "en", "a", 1, 2, 3, 4)] * 300
    rows += [(100 + i, text(rng, 9), "en", rng.choice("ab"), i, 0, 0, 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC)
    seen = []
    for run, parts in ((mixing.RUN, 3), (mixing.RUN, 7), (20, 5)):
        monkeypatch.setattr(mixing, "RUN", run)
        seen.append(sorted((tuple(r) for r in mixing.take_mix(docs.repartition(parts)).collect()), key=str))
    assert seen[0] == seen[1] == seen[2]
