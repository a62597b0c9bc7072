"""Queries of candle patterns, combinations, event studies, signals and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import patterns as p, portfolio as pf, windows as w
from . import sql
from .windows import dense, features, trading_days

QUERIES: dict = {}
ORACLE_SQL: dict = {}
START, END, TOP, REBALANCE, COST = 100, 340, 10, 3, 15.0
LEAST, RELAXED = 80, 5


def add(key: str, run, body: str, ctes: str = sql.FEATURES) -> None:
    QUERIES[key] = run
    ORACLE_SQL[key] = sql.with_(ctes, body)


# --- SQL ---------------------------------------------------------------------
LAGS = ", ".join(f"lag({col}, {k}) over {sql.W} as {s}{k}" for s, col in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for k in (1, 2, 3))
LAGGED = sql.FEATURES + f""",
lagged as (select *, open as o, high as h, low as l, close as c, {LAGS},
  case when count(high) over {sql.t(20)} >= 20 then max(high) over {sql.t(20)} end as high20, lag(ma20, 3) over {sql.W} as ma20_3 from feat)"""


def flag_sql(rules: dict[str, str], name: str = "flagged") -> str:
    return f"{name} as (select *, {', '.join(f'coalesce({rule}, false) as {k}' for k, rule in rules.items())} from lagged)"


def combo_sql(steps) -> str:
    return " and ".join(f"coalesce(lag({q}, {k}) over {sql.W}, false)" if k else q for q, k in steps)


def hits_sql(combos: list, source: str = "flagged", name: str = "hitrows", column: str = "hits") -> str:
    told = ", ".join(f"case when {combo_sql(s)} then '{p.name_of(s)}' end" for s in combos)
    return f"{name} as (select *, list_filter([{told}], lambda x: x is not null) as {column} from {source})"


FORWARD = f"""fwd as (select *, {', '.join(f'lead(filled, {k}) over {sql.W} / filled - 1 as fwd{k}' for k in (1, 3, 5))}
  from (select *, last_value(close ignore nulls) over (partition by code order by date_idx rows between unbounded preceding and current row) as filled from hitrows))"""
GOOD_MAIN = [s for s, _ in p.GOOD]
MAIN_CTES = f"{LAGGED},\n{flag_sql(p.MAIN)},\n{hits_sql(GOOD_MAIN)},\n{FORWARD}"
STUDY = f"""study as (select combo, count(*) as hits, avg(fwd1) as mean_1d, avg(fwd3) as mean_3d, avg(fwd5) as mean_5d
  from (select unnest(hits) as combo, fwd1, fwd3, fwd5 from fwd where date_idx >= {START} and date_idx < {END - 6}) group by combo)"""
KEEP = f"""keep as (select * from study where mean_5d > 0 and hits >= (case when (select coalesce(bool_or(hits >= {LEAST}), false) from study where mean_5d > 0) then {LEAST} else {RELAXED} end))"""
SCORED = """scored as (select f.code, f.date_idx, f.date, f.close, f.ret1, (select count(*) from keep where list_contains(f.hits, keep.combo)) as n from fwd f)"""


def replay_sql(score: str, source: str, gate: str | None = None, frozen: bool = True, k: int = TOP, start: int = START, end: int = END, reb: int = REBALANCE, cost: float = COST, prefix: str = "") -> str:
    """CTEs `<prefix>port`(date_idx, date, ret, n_hold) of a block replay of source(code, date_idx, score)."""
    x = prefix
    block = f"(date_idx - {start}) // {reb}"
    g = "coalesce(g.gate, 1.0) *" if gate else ""
    join = f"left join {gate} g on g.date_idx = d.{'pick_idx' if frozen else 'date_idx'}" if gate else ""
    return f"""{x}ins as (select code, date_idx, {score} as score, {block} as block from {source} where date_idx >= {start} and date_idx < {end} and ({score}) is not null),
{x}picks as (select block, pick_idx, code from (select *, row_number() over (partition by block order by score desc, code) as rn from
   (select i.*, min(date_idx) over (partition by block) as pick_idx from {x}ins i) where date_idx = pick_idx) where rn <= {k}),
{x}nxt as (select code, date_idx, {block} as block, lead(close) over {sql.W} / close - 1 as next_ret from dense),
{x}daily as (select n.date_idx, p.pick_idx, avg(n.next_ret) as mean, count(*) as n_hold from {x}nxt n join {x}picks p on p.block = n.block and p.code = n.code
   where n.date_idx >= p.pick_idx and n.date_idx >= {start} and n.date_idx < {end} group by all),
{x}port as (select cal.date_idx, cal.date, coalesce({g} (d.mean - case when (d.date_idx - {start}) % {reb} = 0 then {cost / 10000.0} else 0.0 end), 0.0) as ret, coalesce(d.n_hold, 0) as n_hold
   from cal left join {x}daily d on d.date_idx = cal.date_idx {join} where cal.date_idx >= {start} and cal.date_idx < {end})"""


def stats_sql(source: str, where: str = "true") -> str:
    return f"""select count(*) as days, round(max_by(nav, date_idx), 6) as nav, round(min(nav / peak - 1), 6) as max_dd, round(stddev_pop(ret) * sqrt(252.0), 6) as vol,
  round(avg(ret) / (stddev_pop(ret) + 1e-12) * sqrt(252.0), 6) as sharpe, round(avg(case when ret > 0 then 1.0 else 0.0 end), 6) as win, round(pow(max_by(nav, date_idx), 252.0 / count(*)) - 1, 6) as ann
from (select *, max(nav) over (order by date_idx rows unbounded preceding) as peak from (select *, product(1 + ret) over (order by date_idx rows unbounded preceding) as nav from {source} where {where}))"""


# --- Spark -------------------------------------------------------------------
def lagged(spark, sf_dir) -> DataFrame:
    return p.with_lags(features(spark, sf_dir)).withColumn("ma20_3", F.lag("ma20", 3).over(w.by_code()))


def days(spark, sf_dir) -> DataFrame:
    return trading_days(spark, sf_dir)


def main_hits(spark, sf_dir) -> DataFrame:
    return p.padded_forward(p.combo_hits(p.flags(lagged(spark, sf_dir), p.MAIN), GOOD_MAIN))


def study(spark, sf_dir, start=START, end=END - 6) -> DataFrame:
    rows = main_hits(spark, sf_dir).where((F.col("date_idx") >= start) & (F.col("date_idx") < end))
    return p.event_study(rows)


def keep(spark, sf_dir) -> DataFrame:
    return p.keep_combos(study(spark, sf_dir), LEAST, RELAXED)


def combo_scores(spark, sf_dir) -> DataFrame:
    """score: number of kept combinations that hit; null where none does. The keep
    list has one row per combination of the rule table at most."""
    kept = keep(spark, sf_dir).agg(F.collect_set("combo").alias("kept")).select("kept").scalar()
    n = F.size(F.array_intersect("hits", kept))
    rows = main_hits(spark, sf_dir)
    return rows.withColumn("score", F.when(n > 0, n)).withColumn("kept_hits", F.array_intersect("hits", kept))


def pattern_query(key: str, rules: dict) -> None:
    add(key, lambda spark, sf_dir: p.flags(lagged(spark, sf_dir), rules).select("code", "date", *rules), f"select code, date, {', '.join(rules)} from flagged", f"{LAGGED},\n{flag_sql(rules)}")


pattern_query("candle_patterns", p.MAIN)
pattern_query("candle_patterns_ext", p.EXTENDED)
pattern_query("candle_patterns_basic", p.BASIC)
pattern_query("dip_patterns", p.DIP)

add("combo_masks", lambda s, d: main_hits(s, d).where(F.size("hits") > 0).select("code", "date", F.explode("hits").alias("combo")), "select code, date, unnest(hits) as combo from fwd where len(hits) > 0", MAIN_CTES)
add("event_study", lambda s, d: study(s, d).select("combo", "hits", *[F.round(c, 6).alias(c) for c in ("mean_1d", "mean_3d", "mean_5d")]), "select combo, hits, round(mean_1d, 6) as mean_1d, round(mean_3d, 6) as mean_3d, round(mean_5d, 6) as mean_5d from study", f"{MAIN_CTES},\n{STUDY}")
add("combo_keep", lambda s, d: keep(s, d).select("combo", "hits", F.round("mean_5d", 6).alias("mean_5d")), "select combo, hits, round(mean_5d, 6) as mean_5d from keep", f"{MAIN_CTES},\n{STUDY},\n{KEEP}")
KEPT = f"{MAIN_CTES},\n{STUDY},\n{KEEP},\n{SCORED}"
add("sig_combo_count", lambda s, d: combo_scores(s, d).where("score is not null").select("code", "date", F.col("score").cast("long").alias("score")), "select code, date, n as score from scored where n > 0", KEPT)

GOOD_W = [(s, x) for s, x in p.GOOD if x is not None]
W_CTES = f"{LAGGED},\n{flag_sql(p.EXTENDED)},\n{hits_sql([s for s, _ in GOOD_W])},\n{hits_sql(p.BAD_WEIGHTED, 'hitrows', 'vetoed', 'bad')}"


def weighted(spark, sf_dir) -> DataFrame:
    rows = p.combo_hits(p.combo_hits(p.flags(lagged(spark, sf_dir), p.EXTENDED), [s for s, _ in GOOD_W]), p.BAD_WEIGHTED, "bad")
    score = sum((F.when(F.array_contains("hits", p.name_of(s)), x / 10.0).otherwise(0.0) for s, x in GOOD_W), F.lit(0.0))
    return rows.withColumn("score", F.when((F.size("hits") > 0) & (F.size("bad") == 0), score))


W_SCORE = " + ".join(f"case when list_contains(hits, '{p.name_of(s)}') then {x / 10.0} else 0.0 end" for s, x in GOOD_W)
add("sig_combo_weighted", lambda s, d: weighted(s, d).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), f"select code, date, round({W_SCORE}, 6) as score from vetoed where len(hits) > 0 and len(bad) = 0", W_CTES)

B_CTES = f"{LAGGED},\n{flag_sql(p.BASIC)},\n{hits_sql(p.GOOD_BASIC)},\n{hits_sql(p.BAD_BASIC, 'hitrows', 'vetoed', 'bad')}"


def basic(spark, sf_dir) -> DataFrame:
    rows = p.combo_hits(p.combo_hits(p.flags(lagged(spark, sf_dir), p.BASIC), p.GOOD_BASIC), p.BAD_BASIC, "bad")
    return rows.withColumn("score", F.when((F.size("hits") > 0) & (F.size("bad") == 0) & (F.col("close") >= F.col("ma20") * 0.97), -F.col("ret1")))


add("sig_combo_basic", lambda s, d: basic(s, d).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), "select code, date, round(-ret1, 6) as score from vetoed where len(hits) > 0 and len(bad) = 0 and close >= ma20 * 0.97 and ret1 is not null", B_CTES)

D_CTES = f"{LAGGED},\n{flag_sql(p.DIP)}"
DIP_SCORE = "case when trend_dip and not chase then -ret1 end"


def dip(spark, sf_dir) -> DataFrame:
    return p.flags(lagged(spark, sf_dir), p.DIP).withColumn("score", F.expr(DIP_SCORE))


add("sig_dip", lambda s, d: dip(s, d).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), f"select code, date, round({DIP_SCORE}, 6) as score from flagged where ({DIP_SCORE}) is not null", D_CTES)

# signals over features
MOMENTUM = {"sig_dual_ma": "case when ma5 > ma20 then ma5 / ma20 - 1 end", "sig_rsi": "case when rsi6 < 25 then 30 - rsi6 end"}
for _key, _rule in MOMENTUM.items():
    add(_key, lambda s, d, r=_rule: features(s, d).withColumn("score", F.expr(r)).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), f"select code, date, round({_rule}, 6) as score from feat where ({_rule}) is not null")


def multifactor(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir)
    r = lambda e: w.average_rank(e, ["date_idx"])
    return f.withColumn("score", 0.5 * r(F.col("ret20")) + 0.3 * r(-F.col("vol20")) + 0.2 * r(-F.log(F.greatest("turn", F.lit(0.2)) + F.lit(0) * F.col("turn"))))


def rank_sql(e: str) -> str:
    return f"case when {e} is not null then (rank() over (partition by date_idx order by {e} nulls last) + (count({e}) over (partition by date_idx, {e}) - 1) / 2.0) / count({e}) over (partition by date_idx) end"


ranked = f"""ranked as (select *, 0.5 * {rank_sql('a')} + 0.3 * {rank_sql('b')} + 0.2 * {rank_sql('e')} as score from (select *, ret20 as a, -vol20 as b, case when turn is not null then -ln(greatest(turn, 0.2)) end as e from feat))"""
add("sig_multifactor", lambda s, d: multifactor(s, d).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), "select code, date, round(score, 6) as score from ranked where score is not null", f"{sql.FEATURES},\n{ranked}")

LIMIT_SCORE = "case when coalesce({lag_limit}, false) and open / {lag_close} - 1 > -0.03 then {lag_streak} + (open / {lag_close} - 1) * 10 end"


def limit_signal(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir)
    for c in ("is_limit", "close", "streak"):
        f = f.withColumn(f"y_{c}", F.lag(c).over(w.by_code()))
    return f.withColumn("score", F.expr(LIMIT_SCORE.format(lag_limit="y_is_limit", lag_close="y_close", lag_streak="y_streak")))


_limit_sql = f"(select *, {LIMIT_SCORE.format(lag_limit=f'lag(is_limit) over {sql.W}', lag_close=f'lag(close) over {sql.W}', lag_streak=f'lag(streak) over {sql.W}')} as score from feat)"
add("sig_limitup", lambda s, d: limit_signal(s, d).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), f"select code, date, round(score, 6) as score from {_limit_sql} where score is not null")


def reversal(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).withColumn("score", F.expr("case when ret1 >= -0.095 and ret10 >= -0.45 then ret10 end"))


add("sig_reversal", lambda s, d: pf.top_k(reversal(s, d), TOP, ascending=True).select("code", "date", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")), f"select code, date, round(ret10, 6) as score, rank from (select *, row_number() over (partition by date_idx order by ret10, code) as rank from feat where ret1 >= -0.095 and ret10 >= -0.45) where rank <= {TOP}")
add("topk_daily", lambda s, d: pf.top_k(multifactor(s, d), TOP, digits=12).select("code", "date", F.col("rank").cast("long").alias("rank")), f"select code, date, rank from (select *, row_number() over (partition by date_idx order by round(score, 12) desc, code) as rank from ranked where score is not null) where rank <= {TOP}", f"{sql.FEATURES},\n{ranked}")


# replays
def port_query(key: str, run, ctes: str) -> None:
    add(key, lambda s, d: run(s, d).select("date", F.round("ret", 6).alias("ret"), F.col("n_hold").cast("long").alias("n_hold")), "select date, round(ret, 6) as ret, n_hold from port", ctes)


def gated(spark, sf_dir, gate=None, frozen=True) -> DataFrame:
    return pf.replay(combo_scores(spark, sf_dir), dense(spark, sf_dir), days(spark, sf_dir), START, END, TOP, REBALANCE, COST, gate, frozen)


GATE = """gates as (select date_idx, red_ma, case when red_ma < 0.35 then 0.30 when red_ma < 0.45 then 0.60 else 1.0 end as gate from
  (select date_idx, avg(red) over (order by date_idx rows between 4 preceding and current row) as red_ma from
    (select date_idx, count(*) filter (ret1 > 0)::double / greatest(count(ret1), 1) as red from feat group by date_idx)))"""
MARKET = """mgates as (select date_idx, case when date_idx < 60 then 1.0 when red < 0.28 and zt < 1.5 then 0.25 when red < 0.38 and zt < 2.5 then 0.6 else 1.0 end as gate from
  (select date_idx, avg(up) over w / (select count(distinct code) from feat) as red, avg(zt) over w as zt from
    (select date_idx, count(*) filter (ret1 > 0) as up, count(*) filter (is_limit) as zt from feat group by date_idx) window w as (order by date_idx rows between 19 preceding and current row)))"""
COUNT = "case when n > 0 then n end"
port_query("bt_rebalance", lambda s, d: pf.replay(dip(s, d), dense(s, d), days(s, d), START, END, TOP, 5, COST), f"{D_CTES},\n{replay_sql(DIP_SCORE, 'flagged', reb=5)}")
port_query("bt_gated", lambda s, d: gated(s, d, pf.breadth_gate(features(s, d))), f"{KEPT},\n{GATE},\n{replay_sql(COUNT, 'scored', 'gates')}")
port_query("bt_market_gate", lambda s, d: gated(s, d, pf.market_gate(features(s, d)), False), f"{KEPT},\n{MARKET},\n{replay_sql(COUNT, 'scored', 'mgates', False)}")
add("breadth_gate_ma", lambda s, d: pf.breadth_gate(features(s, d)).select("date_idx", F.round("red_ma", 6).alias("red_ma"), "gate"), "select date_idx, round(red_ma, 6) as red_ma, gate::double as gate from gates", f"{sql.FEATURES},\n{GATE}")
add("market_gate_20", lambda s, d: pf.market_gate(features(s, d)), "select date_idx, gate::double as gate from mgates", f"{sql.FEATURES},\n{MARKET}")


def daily_turnover(spark, sf_dir) -> DataFrame:
    scores = features(spark, sf_dir).withColumn("score", F.expr(MOMENTUM["sig_dual_ma"]))
    return pf.replay_daily(scores, dense(spark, sf_dir), days(spark, sf_dir), START, END, TOP, COST)


DAILY = f"""dpicks as (select date_idx, code from (select *, row_number() over (partition by date_idx order by ma5 / ma20 - 1 desc, code) as rn from feat where ma5 > ma20 and date_idx >= {START} and date_idx < {END}) where rn <= {TOP}),
dsets as (select date_idx, list(code) as held, lag(list(code)) over (order by date_idx) as before from dpicks group by date_idx),
dturn as (select date_idx, case when before is null then 1.0 else (len(list_filter(held, lambda x: not list_contains(before, x))) + len(list_filter(before, lambda x: not list_contains(held, x))))::double / greatest(len(held), 1) end as turnover from dsets),
dnext as (select code, date_idx, lead(close) over {sql.W} / close - 1 as next_ret from dense),
dret as (select p.date_idx, avg(next_ret) as mean from dpicks p join dnext n using (date_idx, code) group by p.date_idx),
dport as (select cal.date_idx, cal.date, coalesce(mean - turnover * {COST} / 10000.0, 0.0) as ret, case when mean is not null then turnover else 0.0 end as turnover
  from cal left join dturn using (date_idx) left join dret using (date_idx) where cal.date_idx >= {START} and cal.date_idx < {END})"""
D2 = f"{sql.FEATURES},\n{DAILY}"
add("bt_daily_turnover", lambda s, d: daily_turnover(s, d).select("date", F.round("ret", 6).alias("ret"), F.round("turnover", 6).alias("turnover")), "select date, round(ret, 6) as ret, round(turnover, 6) as turnover from dport", D2)
add("symdiff_turnover", lambda s, d: daily_turnover(s, d).select("date", F.round("turnover", 6).alias("turnover")), "select date, round(turnover, 6) as turnover from dport", D2)


def stats_cols(df: DataFrame) -> DataFrame:
    return df.select("days", *[F.round(c, 6).alias(c) for c in ("nav", "max_dd", "vol", "sharpe", "win", "ann")])


add("nav_stats", lambda s, d: stats_cols(pf.nav_stats(daily_turnover(s, d))), stats_sql("dport"), D2)
add("nav_slice", lambda s, d: stats_cols(pf.nav_stats(daily_turnover(s, d).where(F.col("date_idx") >= 220))), stats_sql("dport", "date_idx >= 220"), D2)
add("fit_oos_pipeline", lambda s, d: stats_cols(pf.nav_stats(gated(s, d, pf.breadth_gate(features(s, d))).where(F.col("date_idx") >= END - 60))), stats_sql("port", f"date_idx >= {END - 60}"), f"{KEPT},\n{GATE},\n{replay_sql(COUNT, 'scored', 'gates')}")
add(
    "latest_holdings",
    lambda s, d: _latest(combo_scores(s, d)),
    f"""select code, date, n as score, array_to_string(list_sort(list_intersect(hits, ks)), ';') as combos, round(ret1, 6) as pct
from (select f.*, s.n, (select list(combo) from keep) as ks, row_number() over (order by s.n desc, f.code) as rn from fwd f join scored s using (code, date_idx, date)
  where s.n > 0 and f.date_idx = (select max(date_idx) from scored where n > 0)) where rn <= {TOP}""",
    KEPT,
)


def _latest(scores: DataFrame) -> DataFrame:
    signal = scores.where("score is not null")
    last = signal.where(F.col("date_idx") == signal.select(F.max("date_idx")).scalar())
    return pf.top_k(last, TOP).select("code", "date", F.col("score").cast("long").alias("score"), F.array_join(F.array_sort("kept_hits"), ";").alias("combos"), F.round("ret1", 6).alias("pct"))


FLAGSHIP = QUERIES["event_study"]
