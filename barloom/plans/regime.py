"""Queries of the market regime: index by day from line items, rate from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import portfolio as pf, regime as rg
from ..sources import panel

QUERIES: dict = {}
ORACLE_SQL: dict = {}
KINDS = ("N", "R", "A")


def series(spark, sf_dir) -> DataFrame:
    """Daily sums of prices per return flag: one series each."""
    items = panel.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return items.withColumn("date_idx", F.row_number().over(Window.partitionBy("series_id").orderBy("date")) - 1)


def rates(spark, sf_dir) -> DataFrame:
    """Daily mean order price as a gappy rate, the same for every series."""
    o = panel.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("rate"), F.max("o_orderkey").alias("seq"))
    return o.withColumn("series_id", F.explode(F.array(*[F.lit(k) for k in KINDS])))


def built(spark, sf_dir) -> DataFrame:
    return rg.regime(series(spark, sf_dir), rates(spark, sf_dir))


SERIES = """
series as (select *, row_number() over (partition by series_id order by date) - 1 as date_idx from
  (select l_returnflag as series_id, l_shipdate::date as date, sum(l_extendedprice::decimal(18,2))::double as value from lineitem group by all)),
rates as (select o_orderdate::date as date, sum(o_totalprice::decimal(18,2))::double / count(*) as rate from orders where o_orderkey % 3 = 0 group by 1),
filled as (select s.*, r.rate from series s asof left join rates r on s.date >= r.date)"""
S = "(partition by series_id order by date_idx)"


def win(n: int) -> str:
    return f"(partition by series_id order by date_idx rows between {n - 1} preceding and current row)"


REGIME = SERIES + f""",
chg as (select *, rate - lag(rate, 20) over {S} as rate_chg, value / lag(value, 20) over {S} - 1 as mom20 from filled),
pct as (select *, case when count(value) over {win(1260)} >= 120 then len(list_filter(list(value) over {win(1260)}, lambda x: x < value))::double / count(value) over {win(1260)} end as val_pct,
  case when count(rate_chg) over {win(252)} >= 60 and stddev_samp(rate_chg) over {win(252)} != 0 then -(rate_chg - avg(rate_chg) over {win(252)}) / stddev_samp(rate_chg) over {win(252)} end as rate_bull from chg),
scored as (select *, 0.5 * rate_bull - 0.5 * (val_pct - 0.5) as score, case when mom20 > 0 then 1.0 when mom20 > -0.05 then 0.6 when mom20 is not null then 0.3 end::double as gate from pct),
states as (select *, case when n >= 60 then ql end as q_lo, case when n >= 60 then qh end as q_hi from
  (select *, count(score) over w as n, quantile_cont(score, 0.33) over w as ql, quantile_cont(score, 0.67) over w as qh from scored window w as (partition by series_id order by date_idx rows unbounded preceding))),
stated as (select *, case when score >= q_hi then 'value' when score >= q_lo then 'mood' when score < q_lo then 'defence' end as state from states)"""


def add(key: str, run, body: str | None, ctes: str = REGIME) -> None:
    QUERIES[key] = run
    if body:
        ORACLE_SQL[key] = f"with {ctes}\n{body}"


add("join_asof_ffill", lambda s, d: rg.asof_fill(series(s, d), rates(s, d)).select("series_id", "date", F.round("rate", 6).alias("rate")), "select series_id, date, round(rate, 6) as rate from filled", SERIES)
add("rolling_z", lambda s, d: built(s, d).select("series_id", "date", F.round("rate_bull", 6).alias("rate_bull")), "select series_id, date, round(rate_bull, 6) as rate_bull from pct")
add("rolling_pctile", lambda s, d: rg.rolling_percentile(series(s, d), "value").select("series_id", "date", F.round("pctile", 6).alias("pctile")), "select series_id, date, round(val_pct, 6) as pctile from pct")
add("expanding_tristate", lambda s, d: built(s, d).select("series_id", "date", F.round("score", 5).alias("score"), F.round("q_lo", 5).alias("q_lo"), F.round("q_hi", 5).alias("q_hi"), "state"), "select series_id, date, round(score, 5) as score, round(q_lo, 5) as q_lo, round(q_hi, 5) as q_hi, state from stated")
add("momentum_gate", lambda s, d: built(s, d).select("series_id", "date", "gate"), "select series_id, date, gate from scored")
add("state_counts", lambda s, d: built(s, d).where("state is not null").groupBy("series_id", "state").agg(F.count("*").alias("n")), "select series_id, state, count(*) as n from stated where state is not null group by all")


def held(spark, sf_dir) -> DataFrame:
    return rg.deadband_hold(built(spark, sf_dir), "signal")


POSITION = REGIME + f""",
sig as (select *, case state when 'value' then 0.9 when 'mood' then 0.7 when 'defence' then 0.4 end * gate as signal from stated),
reb as (select series_id, row_number() over (partition by series_id order by date_idx) as k, date_idx, signal from sig where date_idx % 5 = 0 and signal is not null),
fold as (select series_id, k, date_idx, signal, signal as pos from reb where k = 1
  union all select r.series_id, r.k, r.date_idx, r.signal, case when abs(r.signal - f.pos) >= 0.30 then r.signal else f.pos end from fold f join reb r on r.series_id = f.series_id and r.k = f.k + 1),
positions as (select s.*, f.pos as position from sig s asof left join fold f on s.series_id = f.series_id and s.date_idx >= f.date_idx)"""


def add_recursive(key: str, run, body: str) -> None:
    QUERIES[key] = run
    ORACLE_SQL[key] = f"with recursive {POSITION}\n{body}"


add_recursive("deadband_hold", lambda s, d: held(s, d).select("series_id", "date", F.round("position", 6).alias("position")), "select series_id, date, round(position, 6) as position from positions")
add_recursive("turnover_annual", lambda s, d: pf.turnover_annual(held(s, d)).select("series_id", F.round("turnover", 6).alias("turnover")), f"select series_id, round(case when count(*) >= 2 then sum(abs(change)) / (count(*) / 252.0) end, 6) as turnover from (select *, position - lag(position) over {S} as change from positions where position is not null) group by series_id")
add_recursive("timing_nav", lambda s, d: rg.timing_nav(held(s, d)).select("series_id", "days", F.round(F.log("nav"), 5).alias("log_nav"), F.round(F.log("bench"), 5).alias("log_bench")), f"select series_id, count(*) as days, round(ln(product(1 + p * r)), 5) as log_nav, round(ln(product(1 + r)), 5) as log_bench from (select *, value / lag(value) over {S} - 1 as r, lag(position) over {S} as p from positions) where position is not null and p is not null and r is not null group by series_id")


def picked(spark, sf_dir) -> DataFrame:
    """The rate if it has 120 observations, else the proxy with 200, else the rate with 60, else none."""
    n = rates(spark, sf_dir).groupBy("series_id").agg(F.count("rate").alias("n_rate"))
    m = series(spark, sf_dir).groupBy("series_id").agg(F.count("value").alias("n_proxy"))
    source = F.when(F.col("n_rate") >= 120, "rate").when(F.col("n_proxy") >= 200, "proxy").when(F.col("n_rate") >= 60, "rate").otherwise("none")
    return n.join(m, "series_id").select("series_id", "n_rate", "n_proxy", source.alias("source"))


add("rate_source_pick", picked, "select series_id, n_rate, n_proxy, case when n_rate >= 120 then 'rate' when n_proxy >= 200 then 'proxy' when n_rate >= 60 then 'rate' else 'none' end as source from (select series_id, count(value) as n_proxy from series group by 1), (select count(rate) as n_rate from rates)", SERIES)
