"""Literal cases of the operators, and the closed-form replays against plain loops."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalar as sc
from barloom.operators import evaluate as ev, patterns as pt, portfolio as pf, regime as rg, review as rv, sectors as sec, text as tx, windows as w
from barloom.plans import patterns as plans
from barloom.sources import panel


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def small_panel(spark, codes=6, days=40, seed=2, holes=True):
    rng = random.Random(seed)
    rows, day0 = [], date(2026, 1, 5)
    for c in range(codes):
        price = 100.0
        for i in range(days):
            price *= 1 + rng.gauss(0, 0.04)
            if holes and (c, i) in {(1, 7), (1, 8), (2, 20)}:
                continue
            rows.append((day0 + timedelta(days=i), f"{('600', '300')[c % 2]}{c:03d}", price * 0.99, price * 1.02, price * 0.97, price, 1000.0 + i, price * 10))
    return spark.createDataFrame(rows, "date date, code string, open double, high double, low double, close double, volume double, amount double")


def test_shift_is_a_calendar_shift(spark):
    dense = panel.densify(small_panel(spark))
    rows = {(r.code, r.date_idx): r for r in w.pct_change(w.pct_change(dense, "close", 1, "padded"), "close", 1, "raw", pad=False).collect()}
    assert rows["300001", 7].padded == 0.0 and rows["300001", 7].raw is None and rows["300001", 9].raw is None
    assert rows["300001", 9].padded == pytest.approx(rows["300001", 9].close / rows["300001", 6].close - 1)


def test_no_feature_looks_ahead(spark):
    bars = small_panel(spark, holes=False)
    cut = date(2026, 2, 3)
    names = ["ret1", "ret5", "ma5", "ma20", "vol20", "turn", "rsi6", "streak"]
    whole = {(r.code, r.date): [r[n] for n in names] for r in w.features(panel.densify(bars)).collect() if r.date <= cut}
    short = {(r.code, r.date): [r[n] for n in names] for r in w.features(panel.densify(bars.where(F.col("date") <= F.lit(cut)))).collect()}
    assert whole == short


def test_average_rank_and_norms(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (0, "c", 2.0), (0, "d", None), (0, "e", 5.0)], "date_idx int, code string, v double")
    got = {r.code: r.normed for r in w.xs_norm(rows, "v").collect()}
    assert got == {"a": 0.25 - 0.5, "b": 0.625 - 0.5, "c": 0.625 - 0.5, "d": None, "e": 0.5}
    same = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0)], "date_idx int, code string, v double")
    assert {r.normed for r in w.xs_norm(same, "v", "zscore").collect()} == {None}


@pytest.mark.parametrize(("code", "limit"), [("600001", 9.8), ("000001", 9.8), ("300001", 19.8), ("688001", 19.8), ("830001", 29.8), ("430001", 29.8)])
def test_daily_limit(spark, code, limit):
    assert value(spark, w.daily_limit(F.lit(code))) == limit


def test_newey_west(spark):
    rng = random.Random(3)
    rows = [("up", i, 0.01 + rng.gauss(0, 0.002)) for i in range(200)] + [("noise", i, rng.gauss(0, 0.01)) for i in range(500)] + [("few", i, 1.0 * i) for i in range(4)] + [("flat", i, 0.0) for i in range(50)]
    got = {r.factor: r.t_nw for r in ev.newey_west(spark.createDataFrame(rows, "factor string, date_idx int, ic double"), "ic", "factor").collect()}
    assert got["up"] > 10 and abs(got["noise"]) < 3 and got["few"] is None and got["flat"] is None


def test_information_coefficient_dies_when_labels_are_shuffled(spark):
    rng = random.Random(4)
    good = [("f", f"c{c}", d, date(2026, 1, 1) + timedelta(days=d), float(x := rng.gauss(0, 1)), x + rng.gauss(0, 0.5)) for d in range(40) for c in range(50)]
    labels = [r[5] for r in good]
    bad = []
    for d in range(40):
        part = labels[d * 50 : d * 50 + 50]
        rng.shuffle(part)
        bad += [(*r[:5], y) for r, y in zip(good[d * 50 : d * 50 + 50], part, strict=True)]
    schema = "factor string, code string, date_idx int, date date, value double, label double"
    mean = lambda rows: ev.ic_series(spark.createDataFrame(rows, schema)).agg(F.avg("ic")).first()[0]
    assert mean(good) > 0.5 and abs(mean(bad)) < 0.06
    assert ev.ic_series(spark.createDataFrame(good[:10], schema)).first().ic is None


def test_layers_are_monotone_for_a_true_factor(spark):
    rng = random.Random(5)
    rows = [("f", f"c{c:02d}", d, date(2026, 1, 1), x := rng.gauss(0, 1), 0.01 * x + rng.gauss(0, 0.002)) for d in range(20) for c in range(23)]
    layered = ev.layers(spark.createDataFrame(rows, "factor string, code string, date_idx int, date date, value double, next_ret double"))
    assert ev.layer_report(layered).first().mono > 0.9
    assert {r.layer for r in layered.collect()} == {1, 2, 3, 4, 5}


def loop_replay(close, score, start, end, k, reb, cost, gate):
    """The replay's definition as a loop over days."""
    codes, out, hold, g = sorted(close), [], [], 1.0
    for i in range(start, end):
        row = {c: score[c][i] for c in codes if score[c][i] is not None}
        if (i - start) % reb == 0 or not hold:
            hold = [c for c, _ in sorted(row.items(), key=lambda x: (-x[1], x[0]))[:k]]
            g = gate[i] if row else 1.0
        if i + 1 >= len(close[codes[0]]) or not hold:
            out.append(0.0)
            continue
        rets = [close[c][i + 1] / close[c][i] - 1 for c in hold if close[c][i] is not None and close[c][i + 1] is not None]
        if not rets:
            out.append(0.0)
            continue
        r = sum(rets) / len(rets) - (cost / 1e4 if (i - start) % reb == 0 else 0.0)
        out.append(r * g)
    return out


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0])
def test_block_replay_equals_the_loop(spark, share):
    rng = random.Random(int(share * 100))
    dense = panel.densify(small_panel(spark)).cache()
    rows = dense.orderBy("code", "date_idx").collect()
    codes = sorted({r.code for r in rows})
    close = {c: [r.close for r in rows if r.code == c] for c in codes}
    score = {c: [float(rng.randrange(3)) if rng.random() < share else None for _ in close[c]] for c in codes}
    gate = [rng.choice([0.3, 0.6, 1.0]) for _ in range(40)]
    scores = spark.createDataFrame([(c, i, s) for c in codes for i, s in enumerate(score[c])], "code string, date_idx int, score double")
    gates = spark.createDataFrame(list(enumerate(gate)), "date_idx int, gate double")
    got = pf.replay(scores, dense, panel.calendar(dense.where("close is not null")), 5, 40, 2, 3, 15.0, gates).orderBy("date_idx").collect()
    want = loop_replay(close, score, 5, 40, 2, 3, 15.0, gate)
    assert [r.ret for r in got] == pytest.approx(want)


def test_daily_replay_equals_the_loop(spark):
    rng = random.Random(11)
    dense = panel.densify(small_panel(spark, holes=False)).cache()
    rows = dense.orderBy("code", "date_idx").collect()
    codes = sorted({r.code for r in rows})
    close = {c: [r.close for r in rows if r.code == c] for c in codes}
    score = {c: [float(rng.randrange(9)) if rng.random() < 0.4 else None for _ in range(40)] for c in codes}
    scores = spark.createDataFrame([(c, i, s) for c in codes for i, s in enumerate(score[c])], "code string, date_idx int, score double")
    got = pf.replay_daily(scores, dense, panel.calendar(dense), 3, 40, 2, 15.0).orderBy("date_idx").collect()
    before, want = None, []
    for i in range(3, 40):
        row = sorted(((-score[c][i], c) for c in codes if score[c][i] is not None))[:2]
        if not row or i + 1 >= 40:
            want.append(0.0)
            continue
        hold = {c for _, c in row}
        turn = 1.0 if before is None else len(hold ^ before) / max(len(hold), 1)
        want.append(sum(close[c][i + 1] / close[c][i] - 1 for c in hold) / len(hold) - turn * 15 / 1e4)
        before = hold
    assert [r.ret for r in got] == pytest.approx(want)


def test_patterns_are_false_where_bars_are_missing(spark):
    lagged = pt.with_lags(panel.densify(small_panel(spark)))
    row = pt.flags(lagged, pt.MAIN).where("code = '300001' and date_idx = 7").first()
    assert not any(row[n] for n in pt.MAIN)


@pytest.mark.parametrize(("position", "coeff"), [(0.9, 1.0), (0.0, 0.6), (0.27, 0.72), (0.4, 0.7778), (0.7, 0.9111), (1.2, 1.0), (-0.5, 0.6), (None, 1.0), (float("nan"), 1.0)])
def test_macro_coefficient(spark, position, coeff):
    assert value(spark, rv.macro_coefficient(F.lit(position).cast("double"))) == coeff


@pytest.mark.parametrize(("anchor", "position", "lag", "final"), [(5.0, 0.4, 0, 3.9), (5.0, 0.4, -2, 5.0), (5.0, 0.4, 6, 5.0), (5.0, 0.4, 5, 3.9), (1.0, 0.0, 0, 1.0), (9.0, 0.9, 0, 7.0), (5.0, None, 0, 5.0)])
def test_blended_anchor(spark, anchor, position, lag, final):
    day = F.lit("2026-09-16").cast("date")
    assert value(spark, rv.blend_anchor(F.lit(anchor), F.lit(position).cast("double"), F.date_sub(day, lag), day)).final == final


@pytest.mark.parametrize(("seal", "turnover", "top", "risk"), [(99.0, 1.0, True, "high"), (2.0, 39.0, False, "high"), (20.0, 30.0, False, "mid"), (1.0, 0.0, False, "unknown"), (1.0, None, False, "unknown")])
def test_leader_risk(spark, seal, turnover, top, risk):
    assert value(spark, rv.leader_risk(F.lit(seal), F.lit(turnover).cast("double"), F.lit(top))) == risk


@pytest.mark.parametrize(("amount", "complete", "index", "want"), [(18390.09, True, 8711.41, (18390.09, "market")), (1000.0, False, 8711.41, (8711.41, "index")), (1000.0, None, 8711.41, (8711.41, "index")), (None, None, None, (None, "none"))])
def test_amount_caliber(spark, amount, complete, index, want):
    got = value(spark, rv.pick_amount(F.lit(amount).cast("double"), F.lit(complete).cast("boolean"), F.lit(index).cast("double")))
    assert (got.amount, got.scope) == want


@pytest.mark.parametrize(("raw", "want"), [("2,500.00", 2500.0), ("-", None), ("", None), ("nan", None), ("15%", 15.0), ("abc", None), (None, None)])
def test_parse_num(spark, raw, want):
    assert value(spark, sc.parse_num(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("cy", "py", "want"), [(2026, None, 2026), (2026, 2025, 2025), (2026, 2027, 2026), (None, 2025, 2025)])
def test_absolute_years(spark, cy, py, want):
    assert value(spark, sc.absolute_year(F.lit(cy).cast("int"), F.lit(py).cast("int"))) == want


def test_small_scalars(spark):
    assert value(spark, sc.yi(F.lit("214910502"))) == 2.15 and value(spark, sc.yi(F.lit("abc"))) == 0.0
    assert value(spark, sc.code6(F.lit("sh600825"))) == "600825" and value(spark, sc.prefixed(F.lit("600825"))) == "SH600825"
    assert value(spark, sc.title_key(F.lit("新华传媒：今日 涨停！ABC123456789"))) == "新华传媒今日涨停ABC1"
    assert value(spark, sc.clean_html(F.lit("<em>量</em><em>产</em> &amp;  x"))) == "量产 & x"
    assert str(value(spark, sc.prev_weekday(F.lit("2026-11-23").cast("date")))) == "2026-11-20"


@pytest.mark.parametrize(("parts", "want"), [((0.2, 2.0, 0.2), (100.0, 3, True)), ((None, 2.0, 0.2), (100.0, 2, True)), ((None, 3.22, None), (100.0, 1, False)), ((None, None, None), (0.0, 0, False)), ((-0.5, None, None), (0.0, 1, False))])
def test_score_a(spark, parts, want):
    got = value(spark, sc.score_a(*[F.lit(p).cast("double") for p in parts]))
    assert (got.score, got.n, got.rankable) == want


@pytest.mark.parametrize(("parts", "want"), [((-0.156, -1.56, 0.228), 28.9), ((-0.5, -1.56, 0.3), 28.9), ((None, None, 0.1234), 80.9), ((None, None, 0.123), 80.8)])
def test_score_a_rounds_halves_up_whatever_their_noise(spark, parts, want):
    """0.11 * 0.35 + 0.25 is 0.2885, but 28.849999999999998 as doubles have it (F1)."""
    assert value(spark, sc.score_a(*[F.lit(p).cast("double") for p in parts])).score == want


def test_daily_top_takes_scores_equal_to_twelve_digits_as_ties(spark, monkeypatch):
    """0.1 + 0.2 is above 0.3 by its last bit only: the code decides, as in the SQL (F3)."""
    rows = [("600002", date(2026, 1, 5), 0, 0.1 + 0.2), ("600001", date(2026, 1, 5), 0, 0.3), ("600003", date(2026, 1, 5), 0, 0.3 + 1e-11), ("600000", date(2026, 1, 5), 0, None)]
    scores = spark.createDataFrame(rows, "code string, date date, date_idx int, score double")
    monkeypatch.setattr(plans, "multifactor", lambda s, d: scores)
    assert [r.code for r in plans.QUERIES["topk_daily"](spark, "").orderBy("rank").collect()] == ["600003", "600001", "600002"]


def test_pulse_score_of_shared_codes_does_not_follow_the_order_of_rows(spark):
    f = w.features(panel.densify(small_panel(spark, codes=8, days=60, holes=False)))
    pools = [(code, sector) for i, code in enumerate(sorted(r.code for r in f.select("code").distinct().collect())) for sector in (f"s{i % 3}", f"s{(i + 1) % 3}")]
    one, two = (sec.pulse_score(f, spark.createDataFrame(x, "code string, sector string").coalesce(1)).select("code", "date_idx", "sector", "stock_heat", "score") for x in (pools, pools[::-1]))
    rows = sorted(one.collect(), key=str)
    assert len(rows) == 960 and sum(r.score is not None for r in rows) > 100 and rows == sorted(two.collect(), key=str)


def test_traps_and_news(spark):
    got = value(spark, tx.traps(F.lit("框架协议不具有法律效力，没有强制约束力")))
    assert (got["framework"], got["not binding"], got["firm"]) == (1, 2, 0)
    rows = [("a", "2026-09-16 10:00", "新华传媒今日涨停大涨消息甲", "新华传媒 今日涨停大涨消息甲"), ("a", "2026-09-16 09:00", "新华传媒今日涨停大涨消息乙", "later"), ("a", "2026-09-17 09:00", "tomorrow's news", "x"), ("a", "2026-09-16 08:00", "", "x")]
    items = spark.createDataFrame(rows, "category string, time string, title string, summary string")
    kept = tx.news_clean(items, "2026-09-16").collect()
    assert [(r.time, r.summary) for r in kept] == [("2026-09-16 09:00", "later")]
    late = tx.news_clean(items, "2026-09-16", late=True).orderBy("time").collect()
    assert late[-1].summary == "[after] x" and len(late) == 2


def test_deadband_and_percentile_match_loops(spark):
    rng = random.Random(7)
    values = [rng.gauss(100, 5) for _ in range(300)]
    signal = [rng.choice([0.12, 0.42, 0.9, None]) for _ in values]
    rows = spark.createDataFrame([("s", i, v, s) for i, (v, s) in enumerate(zip(values, signal, strict=True))], "series_id string, date_idx int, value double, signal double")
    got = rg.rolling_percentile(rg.deadband_hold(rows, "signal"), "value", 100, 20).orderBy("date_idx").collect()
    now = None
    for i, r in enumerate(got):
        if i % 5 == 0 and signal[i] is not None and (now is None or abs(signal[i] - now) >= 0.30):
            now = signal[i]
        assert r.position == now
        past = values[max(0, i - 99) : i + 1]
        want = sum(x < values[i] for x in past) / len(past) if len(past) >= 20 else None
        assert (r.pctile is None) == (want is None) and (want is None or math.isclose(r.pctile, want))


def test_news_window_keeps_what_it_cannot_read_by_containment(spark):
    times = ["2026-09-16 10:00", "2026/9/17 23:59:59", "9-14 00:00", "09-13 23:59", None, "", "about 2026-09-16", "yesterday", "2026-09-18 00:01"]
    items = spark.createDataFrame(list(enumerate(times)), "id int, time string")
    assert [r.id for r in tx.news_window(items, "2026-09-16").orderBy("id").collect()] == [0, 1, 2, 4, 5, 6]
    assert tx.news_window(items.where("id in (3, 7)"), "2026-09-16").count() == 2
