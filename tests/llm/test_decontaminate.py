"""Spaced seeds against a brute-force search over all positions."""

import random
import re
import time

import numpy as np
import pytest

from barloom.llm import decontaminate as dec


def plain(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Best stretch of each document and item on the diagonals that a seed or a whole short item hits."""
    out = {}
    for d, text in docs:
        w = plain(text)
        for i, said in items:
            m = plain(said)
            if i is None or not m:
                continue
            span = min(20, len(m))
            masks = dec.MASKS if len(m) > 5 else ("1" * len(m),)
            for diagonal in range(-len(m) + 1, len(w)):
                same = [0 <= diagonal + k < len(w) and w[diagonal + k] == m[k] for k in range(len(m))]
                inside = [0 <= diagonal + k < len(w) for k in range(len(m))]
                if not any(all(same[k + j] for j, c in enumerate(mask) if c == "1") and all(inside[k : k + len(mask)]) for mask in masks for k in range(len(m) - len(mask) + 1)):
                    continue
                for k in range(len(m) - span + 1):
                    n = sum(same[k : k + span])
                    if all(inside[k : k + span]) and n >= 0.8 * span:
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (n, span, -(diagonal + k)))
    return {(*k, n, span, -back) for k, (n, span, back) in out.items()}


@pytest.mark.parametrize("shard_tokens", [250_000, 10])
def test_all_substitutions_match_brute_force(spark, shard_tokens):
    rng = random.Random(3)
    say = lambda n, kinds=300: [f"w{rng.randrange(kinds)}" for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([30, 25, 20, 12, 7, 6, 5, 3, 1, 40])] + [(20, ["la"] * 30), (21, ["ab", "cd"] * 12)]
    docs = []
    for k, m in items:
        for cut in range(4):
            leak = list(m)
            for at in rng.sample(range(len(leak)), min(len(leak), cut * len(leak) // 10)):
                leak[at] = "zz"
            docs.append((100 * k + cut, " ".join(say(rng.randrange(8)) + leak + say(rng.randrange(8)))))
    docs += [(5000, "la " * 90), (5001, "ab cd " * 40), (5002, None), (5003, ""), (5004, " ".join(say(60)).upper())]
    rows = [(k, " ".join(m)) for k, m in items] + [(30, None), (31, "...")]
    table = spark.createDataFrame([(*d, 7, "m") for d in docs], "doc_id long, text string, item_id int, met string")
    got = dec.leaks(table, spark.createDataFrame(rows, "item_id long, text string"), shard_tokens=shard_tokens).collect()
    assert {tuple(r) for r in got} == brute(docs, rows) and len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_repetitive_texts_stay_cheap():
    shard = dec.Shard([1], ["again " * 100])
    data = np.frombuffer(b"again " * 100_000, np.uint8)
    word, first = dec.tokens(data, np.array([0, len(data)]))
    began = time.time()
    assert list(shard.matches(word, first, 0.8)) == [(0, 0, 20, 20, 0)]
    assert time.time() - began < 5
