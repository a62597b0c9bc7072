"""The learned score on a planted factor, against the same panel with labels shuffled."""

import datetime
import math
import random

import pytest

from barloom.operators import model

TRAIN, VALID, END, CODES = 120, 160, 220, 25
KIND = "date_idx int, date date, code string, close double, x double, noise double, label double"


def panel(shuffled):
    rng = random.Random(5)
    rows = []
    for c in range(CODES):
        close = 100.0
        for d in range(END):
            x = rng.gauss(0, 1)
            ret = 0.02 * math.tanh(x) + rng.gauss(0, 0.005)
            rows.append([d, datetime.date(2024, 1, 1) + datetime.timedelta(days=d), f"c{c:02}", close, x if (c, d) != (3, 190) else None, rng.gauss(0, 1), ret if d < END - 1 else None])
            close *= 1 + ret
    if shuffled:
        labels = [r[6] for r in rows if r[6] is not None]
        rng.shuffle(labels)
        for r in rows:
            r[6] = labels.pop() if r[6] is not None else None
    return rows


@pytest.fixture(scope="module")
def replays(spark, tmp_path_factory):
    out = {}
    for shuffled in (False, True):
        rows = spark.createDataFrame(panel(shuffled), KIND)
        trees = model.fit(rows, ["x", "noise"], "label", TRAIN, VALID, 1, f"file://{tmp_path_factory.mktemp('trees')}/m", rounds=25, depth=3)
        scored = model.score(rows, ["x", "noise"], trees)
        days = rows.select("date_idx", "date").distinct()
        out[shuffled] = trees, scored.cache(), model.nav(scored, rows, days, VALID, END, 5).orderBy("date_idx").collect()
    return out


def test_a_planted_factor_beats_a_shuffled_one_out_of_sample(replays):
    planted, shuffled = (replays[k][2] for k in (False, True))
    assert len(planted) == END - VALID - 1 and all(r.n_hold == 5 for r in planted)
    assert planted[-1].nav > 1.3 * max(shuffled[-1].nav, planted[-1].bench_nav)
    assert planted[-1].bench_nav == pytest.approx(shuffled[-1].bench_nav)


def test_validation_stops_the_growth(replays):
    assert replays[True][0].getNumTrees < replays[False][0].getNumTrees <= 25


def test_scores_need_every_factor_and_the_replay_adds_up(replays):
    _, scored, daily = replays[False]
    assert [(r.code, r.date_idx) for r in scored.where("score is null").collect()] == [("c03", 190)]
    grown = 1.0
    for r in daily:
        grown *= 1 + r.ret
        assert r.nav == pytest.approx(grown)
