"""Queries of factor evaluation and of features that rank or look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import evaluate as ev, portfolio as pf, windows as w
from ..sources import panel
from . import sql
from .patterns import rank_sql
from .windows import dense, features

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LEAST, HORIZON, LAYERS, MIN_AMOUNT = 10, 5, 5, 20.0


def add(key: str, run, body: str, ctes: str = sql.FEATURES) -> None:
    QUERIES[key] = run
    ORACLE_SQL[key] = sql.with_(ctes, body)


def labelled(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir)
    f = f.withColumn("tradable", F.col("close").isNotNull() & F.col("volume").isNotNull() & (F.col("volume") >= MIN_AMOUNT) & ~F.col("is_limit"))
    return pf.next_return(w.forward_return(f, "close", HORIZON, "label"))


def factors(spark, sf_dir) -> DataFrame:
    """Long factor rows: reversal, momentum and size of turnover."""
    rows = labelled(spark, sf_dir)
    each = F.explode(F.map_from_arrays(F.array(F.lit("mom5"), F.lit("rev1"), F.lit("volume")), F.array("ret5", -F.col("ret1"), F.col("volume"))))
    return rows.select("code", "date_idx", "date", "label", "next_ret", each.alias("factor", "value"))


LABELLED = sql.FEATURES + f""",
labelled as (select *, close is not null and volume is not null and coalesce(volume >= {MIN_AMOUNT}, false) and not is_limit as tradable,
  lead(close, {HORIZON}) over {sql.W} / close - 1 as label, lead(close) over {sql.W} / close - 1 as next_ret from feat),
factors as (select code, date_idx, date, label, next_ret, unnest(['mom5', 'rev1', 'volume']) as factor, unnest([ret5, -ret1, volume]) as value from labelled)"""
_rank = lambda e: rank_sql(e).replace("partition by date_idx", "partition by factor, date_idx")
IC = LABELLED + f""",
franks as (select *, {_rank('value')} as rx, {_rank('label')} as ry from factors),
ics as (select factor, date_idx, date, case when count(*) filter (rx is not null and ry is not null) >= {LEAST} and not isnan(corr(rx, ry) filter (rx is not null and ry is not null)) then corr(rx, ry) filter (rx is not null and ry is not null) end as ic from franks group by all)"""


def newey_sql(source: str, value: str, by: str, lag: int | None, most: int = 12) -> str:
    top = lag if lag is not None else most
    used = str(lag) if lag is not None else f"least(floor(4 * pow(n / 100.0, {2 / 9!r})), {most})"
    gs = ", ".join(f"sum(d * d{k}) as g{k}" for k in range(1, top + 1))
    ds = ", ".join(f"lag(d, {k}) over (partition by {by} order by date_idx) as d{k}" for k in range(1, top + 1))
    terms = " + ".join(f"case when u >= {k} then 2 * (1 - {k} / (u + 1.0)) * coalesce(g{k}, 0) / n else 0 end" for k in range(1, top + 1))
    return f"""(select {by}, n, mean, case when n >= 5 and (g0 / n + {terms}) / n > 0 then mean / sqrt((g0 / n + {terms}) / n) end as t_nw from
  (select *, greatest(least({used}, n - 1), 0) as u from (select {by}, count(*) as n, avg({value}) as mean, sum(d * d) as g0, {gs} from
    (select *, {ds} from (select *, {value} - avg({value}) over (partition by {by}) as d from {source} where {value} is not null)) group by {by})))"""


add("xs_norm", lambda s, d: w.xs_norm(w.xs_norm(features(s, d), "ret5", "rank", "ranked"), "ret5", "zscore", "scored").select("code", "date", F.round("ranked", 6).alias("ranked"), F.round("scored", 6).alias("scored")),
    f"select code, date, round({rank_sql('ret5')} - 0.5, 6) as ranked, round((ret5 - avg(ret5) over (partition by date_idx)) / nullif(stddev_samp(ret5) over (partition by date_idx), 0), 6) as scored from feat")
add("build_label", lambda s, d: labelled(s, d).select("code", "date", F.round(F.when(F.col("tradable"), F.col("label")), 6).alias("label")), "select code, date, round(case when tradable then label end, 6) as label from labelled", LABELLED)
add("tradable_mask", lambda s, d: labelled(s, d).select("code", "date", F.coalesce("tradable", F.lit(False)).alias("tradable")), "select code, date, tradable from labelled", LABELLED)
add("ic_series", lambda s, d: ev.ic_series(factors(s, d), least=LEAST).select("factor", "date", F.round("ic", 6).alias("ic")), "select factor, date, round(ic, 6) as ic from ics", IC)
REPORT = f"""report as (select b.factor, n_days, ic_mean, ic_std, ic_mean / nullif(ic_std, 0) as icir, t_nw, win_rate from
  (select factor, count(*) as n_days, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, avg(case when ic > 0 then 1.0 else 0.0 end) as win_rate from ics where ic is not null group by factor) b
  join {newey_sql('ics', 'ic', 'factor', HORIZON)} t on t.factor = b.factor)"""
REPORT_COLS = ("ic_mean", "ic_std", "icir", "t_nw", "win_rate")
add("ic_report", lambda s, d: ev.ic_report(ev.ic_series(factors(s, d), least=LEAST), HORIZON).select("factor", "n_days", *[F.round(c, 6).alias(c) for c in REPORT_COLS]), f"select factor, n_days, {', '.join(f'round({c}, 6) as {c}' for c in REPORT_COLS)} from report", f"{IC},\n{REPORT}")
add("newey_west_t", lambda s, d: ev.newey_west(ev.ic_series(factors(s, d), least=LEAST), "ic", "factor").select("factor", "n", F.round("mean", 6).alias("mean"), F.round("t_nw", 6).alias("t_nw")), f"select factor, n, round(mean, 6) as mean, round(t_nw, 6) as t_nw from {newey_sql('ics', 'ic', 'factor', None)}", IC)
LAYERED = f"""layered as (select factor, date_idx, date, greatest(ceil((r - 1) * {LAYERS} / (n - 1.0)), 1)::int as layer, avg(next_ret) as ret from
  (select *, count(*) over (partition by factor, date_idx) as n, row_number() over (partition by factor, date_idx order by value, code) as r from factors where value is not null and next_ret is not null)
  where n >= {LEAST} group by all),
lreport as (select m.factor, mono, ls_ann from (select factor, corr(layer, m) as mono from (select factor, layer, avg(ret) as m from layered group by all) group by factor) m
  join (select factor, pow(1 + avg(hi - lo), 252) - 1 as ls_ann from (select factor, date_idx, max(ret) filter (layer = {LAYERS}) as hi, max(ret) filter (layer = 1) as lo from layered group by all) group by factor) x using (factor))"""
add("layer_returns", lambda s, d: ev.layers(factors(s, d), LAYERS, LEAST).select("factor", "date", "layer", F.round("ret", 6).alias("ret")), "select factor, date, layer, round(ret, 6) as ret from layered", f"{LABELLED},\n{LAYERED}")
add("layer_report_day", lambda s, d: ev.layers(factors(s, d).where("date_idx = 200 and factor = 'mom5'"), LAYERS, LEAST).select("layer", F.round("ret", 6).alias("ret")), "select layer, round(ret, 6) as ret from layered where date_idx = 200 and factor = 'mom5'", f"{LABELLED},\n{LAYERED}")


def factor_report(spark, sf_dir) -> DataFrame:
    rows = factors(spark, sf_dir)
    both = ev.ic_report(ev.ic_series(rows, least=LEAST), HORIZON).join(ev.layer_report(ev.layers(rows, LAYERS, LEAST), LAYERS), "factor")
    return both.orderBy(F.col("icir").desc_nulls_last(), "factor").select("factor", "n_days", *[F.round(c, 6).alias(c) for c in (*REPORT_COLS, "mono")], F.round(F.log1p("ls_ann"), 6).alias("ls_log_ann"))


add("factor_report", factor_report, f"select factor, n_days, {', '.join(f'round({c}, 6) as {c}' for c in (*REPORT_COLS, 'mono'))}, round(ln(1 + ls_ann), 6) as ls_log_ann from report join lreport using (factor)", f"{IC},\n{REPORT},\n{LAYERED}")

# projections and filters over the panel
add("universe_board", lambda s, d: panel.weekly_bars(s, d).where(F.substring("code", 1, 3).isin("600", "000", "300")).groupBy("code").agg(F.count("*").alias("bars")), "select code, count(*) as bars from bars where code[1:3] in ('600', '000', '300') group by code", sql.BARS)
add("universe_drop_flagged", lambda s, d: panel.instruments(s, d).where(~F.col("name").rlike(r"ST|PT|退|^\*")).select("code", "name"), "select code, name from inst where not (name like '%ST%' or name like '%PT%' or name like '%退%' or name like '*%')", sql.BARS)
add("limit_pct", lambda s, d: panel.instruments(s, d).select("code", w.daily_limit(F.col("code")).alias("limit_pct")), "select code, (case when code[1] in ('8', '4') then 29.8 when code[1:2] in ('30', '68') then 19.8 else 9.8 end)::double as limit_pct from inst", sql.BARS)
HIT = "ret1 * 100 >= lim - 0.2"
_lim = "(case when code[1] in ('8', '4') then 29.8 when code[1:2] in ('30', '68') then 19.8 else 9.8 end)"


def detect(spark, sf_dir) -> DataFrame:
    """Limit-ups close at the limit; failed ones touched it and closed below."""
    f = features(spark, sf_dir).withColumn("prev", F.lag("close").over(w.by_code())).withColumn("lim", w.daily_limit(F.col("code")))
    up = (F.col("close") / F.col("prev") - 1) * 100 >= F.col("lim") - 0.2
    touched = (F.col("high") / F.col("prev") - 1) * 100 >= F.col("lim") - 0.2
    return f.withColumn("limit_up", F.coalesce(up, F.lit(False))).withColumn("failed", F.coalesce(touched & ~up, F.lit(False))).withColumn("down", F.coalesce((F.col("close") / F.col("prev") - 1) * 100 <= -(F.col("lim") - 0.2), F.lit(False)))


DETECT = sql.FEATURES + f""",
det as (select *, coalesce((close / prev - 1) * 100 >= lim - 0.2, false) as limit_up, coalesce((high / prev - 1) * 100 >= lim - 0.2 and not ((close / prev - 1) * 100 >= lim - 0.2), false) as failed,
  coalesce((close / prev - 1) * 100 <= -(lim - 0.2), false) as down from (select *, lag(close) over {sql.W} as prev, {_lim}::double as lim from feat))"""
add("limit_up_detect", lambda s, d: detect(s, d).where("limit_up or failed").select("code", "date", "limit_up", "failed"), "select code, date, limit_up, failed from det where limit_up or failed", DETECT)
add("limit_up_pct_only", lambda s, d: features(s, d).withColumn("lim", w.daily_limit(F.col("code"))).withColumn("pct", F.col("ret1") * 100).where("pct >= lim - 2.8").select("code", "date", (F.col("pct") >= F.col("lim") - 0.2).alias("limit_up"), (F.col("pct") < F.col("lim") - 0.2).alias("failed")), f"select code, date, ret1 * 100 >= {_lim}::double - 0.2 as limit_up, ret1 * 100 < {_lim}::double - 0.2 as failed from feat where ret1 * 100 >= {_lim}::double - 2.8")
add("market_stats", lambda s, d: detect(s, d).groupBy("date").agg(F.count_if(F.col("ret1") > 0).alias("up"), F.count_if(F.col("ret1") < 0).alias("down"), F.count_if("limit_up").alias("zt"), F.count_if("down").alias("dt"), F.count_if("failed").alias("zb"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / 1e8, 6).alias("amount_yi")),
    "select date, count(*) filter (ret1 > 0) as up, count(*) filter (ret1 < 0) as down, count(*) filter (limit_up) as zt, count(*) filter (down) as dt, count(*) filter (failed) as zb, round(sum(amount::decimal(18,2))::double / 1e8, 6) as amount_yi from det group by date", DETECT)
add("zb_rate", lambda s, d: detect(s, d).groupBy("date").agg(F.count_if("limit_up").alias("zt"), F.count_if("failed").alias("zb")).select("date", F.round(F.when(F.col("zt") + F.col("zb") > 0, F.col("zb") * 100.0 / (F.col("zt") + F.col("zb"))).otherwise(0.0), 1).alias("zb_rate")), "select date, round(case when zt + zb > 0 then zb * 100.0::double / (zt + zb) else 0.0 end, 1) as zb_rate from (select date, count(*) filter (limit_up) as zt, count(*) filter (failed) as zb from det group by date)", DETECT)
DAY = "1998-03-04"
add("snapshot_on", lambda s, d: _snapshot(features(s, d).withColumn("prev_close", F.lag("close").over(w.by_code()))), f"select code, date, open, close, prev_close, round(ret1, 6) as pct from (select *, lag(close) over {sql.W} as prev_close from feat) where date = (select max(date) from cal where date <= date '{DAY}') and close is not null")
add("stock_window", lambda s, d: panel.weekly_bars(s, d).where((F.col("code") == "600003") & (F.col("date") <= F.lit(DAY).cast("date"))).orderBy(F.desc("date")).limit(20).select("date", "open", "high", "low", "close", "volume"), f"select date, open, high, low, close, volume from bars where code = '600003' and date <= date '{DAY}' order by date desc limit 20", sql.BARS)
add("time_lock_slice", lambda s, d: panel.weekly_bars(s, d).where(F.col("date") <= F.lit(DAY).cast("date")).select("code", "date", "close"), f"select code, date, close from bars where date <= date '{DAY}'", sql.BARS)
add("time_lock_check", lambda s, d: panel.weekly_bars(s, d).agg(F.max("date").alias("last"), F.count_if(F.col("date") > F.lit(DAY).cast("date")).alias("late")), f"select max(date) as last, count(*) filter (date > date '{DAY}') as late from bars", sql.BARS)
add("count_distinct_days", lambda s, d: panel.calendar(panel.weekly_bars(s, d)).orderBy(F.desc("date")).limit(5).select("date", F.col("date_idx").cast("long").alias("date_idx")), "select date, date_idx from cal order by date desc limit 5", sql.BARS)
add("top_abs_move", lambda s, d: _last_moves(features(s, d)), "select code, round(ret1, 6) as pct from feat where date_idx = (select max(date_idx) from cal) and close is not null and ret1 is not null order by abs(ret1) desc, code limit 20")
add("src_panel_long", lambda s, d: dense(s, d).where("close is not null").drop("date_idx"), "select date, code, open, high, low, close, volume, amount from bars where close is not null", sql.BARS)
WIDE = ("600000", "000000", "300000")
add("src_long_to_wide", lambda s, d: panel.long_to_wide(panel.weekly_bars(s, d), list(WIDE), 60), f"select date, {', '.join(f'''max(close) filter (code = '{c}') as \"{c}\"''' for c in WIDE)} from bars where date in (select date from cal order by date desc limit 60) and code in {WIDE} group by date", sql.BARS)
add("src_wide_to_long", lambda s, d: panel.wide_to_long(panel.long_to_wide(panel.weekly_bars(s, d), list(WIDE))), f"select date, code, close from bars where code in {WIDE}", sql.BARS)
add("universe_ordered_cap", lambda s, d: _ordered(panel.instruments(s, d)), "select code, rank from (select code, row_number() over (order by case code[1:3] when '600' then 0 when '000' then 0 when '300' then 1 else 2 end, code) as rank from inst where code[1:3] in ('600', '000', '300', '688')) where rank <= 50", sql.BARS)


def _ordered(inst: DataFrame) -> DataFrame:
    """The first 50 instruments by board (main, growth, star), then code: a top-k report."""
    board = F.substring("code", 1, 3)
    order = F.when(board.isin("600", "000"), 0).when(board == "300", 1).otherwise(2)
    top = inst.where(board.isin("600", "000", "300", "688")).withColumn("board", order).orderBy("board", "code").limit(50)
    return top.select("code", F.row_number().over(Window.orderBy("board", "code")).cast("long").alias("rank"))


def _snapshot(f: DataFrame) -> DataFrame:
    day = f.where(F.col("date") <= F.lit(DAY).cast("date")).select(F.max("date")).scalar()
    return f.where((F.col("date") == day) & F.col("close").isNotNull()).select("code", "date", "open", "close", "prev_close", F.round("ret1", 6).alias("pct"))


def _last_moves(f: DataFrame) -> DataFrame:
    last = f.select(F.max("date_idx")).scalar()
    return f.where((F.col("date_idx") == last) & F.col("close").isNotNull() & F.col("ret1").isNotNull()).orderBy(F.abs("ret1").desc(), "code").limit(20).select("code", F.round("ret1", 6).alias("pct"))
