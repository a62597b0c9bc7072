"""Queries of sectors, rotation, set operations, sources and models."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import model, portfolio as pf, sectors as sec, text as tx, windows as w
from ..sources import columns, panel
from . import patterns, sql
from .windows import dense, features, trading_days

QUERIES: dict = {}
ORACLE_SQL: dict = {}
START, END = 100, 340


def add(key: str, run, body: str | None, ctes: str = sql.FEATURES) -> None:
    QUERIES[key] = run
    if body:
        ORACLE_SQL[key] = sql.with_(ctes, body) if ctes else body


def pools(spark, sf_dir) -> DataFrame:
    return panel.instruments(spark, sf_dir).select("code", "sector")


SEC = sql.FEATURES + """,
sdays as (select *, case when count(eq_ret) over m >= 20 then product(1 + eq_ret) over m - 1 end as mom, case when count(hot) over h >= 10 then avg(hot) over h end as heat from
  (select sector, date_idx, date, avg(ret1) as eq_ret, (count(*) filter (is_limit) + count(*) filter (is_big))::double as hot from feat join inst using (code) group by all)
  window m as (partition by sector order by date_idx rows between 19 preceding and current row), h as (partition by sector order by date_idx rows between 9 preceding and current row))"""
add("sector_eq_return", lambda s, d: sec.sector_days(features(s, d), pools(s, d)).select("sector", "date", F.round("eq_ret", 6).alias("eq_ret")), "select sector, date, round(eq_ret, 6) as eq_ret from sdays", SEC)
add("sector_momentum", lambda s, d: sec.sector_days(features(s, d), pools(s, d)).select("sector", "date", F.round(F.log1p("mom"), 6).alias("log_mom")), "select sector, date, round(ln(1 + mom), 6) as log_mom from sdays", SEC)
add("sector_heat", lambda s, d: sec.sector_days(features(s, d), pools(s, d)).select("sector", "date", F.round("heat", 6).alias("heat")), "select sector, date, round(heat, 6) as heat from sdays", SEC)
POOL = "pool as (select sector, code, rank from (select sector, code, row_number() over (partition by sector order by m desc, code) as rank from (select code, avg(volume) as m from dense where date_idx > (select max(date_idx) from cal) - 120 group by code) join inst using (code) where m is not null) where rank <= 5)"
add("core_pool", lambda s, d: sec.core_pool(dense(s, d), pools(s, d), 5, 120), "select * from pool", f"{sql.BARS},\n{POOL}")
EMO = sql.FEATURES + f""",
emo as (select *, emotion - lag(emotion, 3) over {sql.W} as emotion_chg from (select *, case when count(*) over {sql.t(10)} >= 10 then sum(is_limit::int + is_big::int) over {sql.t(10)} / 10.0::double end as emotion from feat)),
emor as (select *, {patterns.rank_sql('emotion')} as emotion_rank from emo)"""
add("emotion_proxy", lambda s, d: sec.emotion(features(s, d)).select("code", "date", *[F.round(c, 6).alias(c) for c in ("emotion", "emotion_chg", "emotion_rank")]), "select code, date, round(emotion, 6) as emotion, round(emotion_chg, 6) as emotion_chg, round(emotion_rank, 6) as emotion_rank from emor", EMO)
PULSE = EMO + f""",
heat as (select *, avg(hh) over (partition by sector, date_idx) as a, ret20 as b, -vol20 as c, -turn as e from (select *, case when count(*) over {sql.t(10)} >= 10 then sum(is_limit::int + is_big::int) over {sql.t(10)} end as hh from emor join inst using (code))),
pulse as (select *, case when emotion_rank < 0.95 and emotion_chg >= -0.15 then 0.4 * {patterns.rank_sql('a')} + 0.4 * {patterns.rank_sql('b')} + 0.1 * {patterns.rank_sql('c')} + 0.1 * {patterns.rank_sql('e')} end as score from heat)"""
add("sig_sectorpulse", lambda s, d: sec.pulse_score(features(s, d), pools(s, d)).where("score is not null").select("code", "date", F.round("score", 6).alias("score")), "select code, date, round(score, 6) as score from pulse where score is not null", PULSE)
ROT = f"""{SEC},
srank as (select sector, date_idx, row_number() over (partition by date_idx order by s, sector) as place from (select *, 0.6 * (rank() over (partition by date_idx order by mom desc) + (count(*) over (partition by date_idx, mom) - 1) / 2.0) + 0.4 * (rank() over (partition by date_idx order by heat desc) + (count(*) over (partition by date_idx, heat) - 1) / 2.0) as s from sdays where mom is not null and heat is not null)),
rot as (select n.date_idx, n.date, sum([0.5, 0.3, 0.2][r.place] * coalesce(n.next, 0.0)) - case when (n.date_idx - {START}) % 5 = 0 then 0.0012 else 0.0 end as ret
  from (select *, lead(eq_ret) over (partition by sector order by date_idx) as next from sdays) n join srank r on r.sector = n.sector and r.date_idx = {START} + ((n.date_idx - {START}) // 5) * 5 and r.place <= 3
  where n.date_idx >= {START} and n.date_idx < {END} group by n.date_idx, n.date)"""


def rotated(spark, sf_dir) -> DataFrame:
    return sec.rotation(sec.sector_days(features(spark, sf_dir), pools(spark, sf_dir)), START, END, 5)


add("bt_sector_rotation", lambda s, d: rotated(s, d).select("date", F.round("ret", 5).alias("ret")), "select date, round(ret, 5) as ret from rot", ROT)
CORE = f"""{ROT},
{POOL},
core as (select date_idx, date, coalesce(avg(next_ret), 0.0) as ret from (select *, lead(close) over {sql.W} / close - 1 as next_ret from dense) where code in (select code from pool) and date_idx >= {START} and date_idx < {END} group by all)"""
add("bt_core_satellite", lambda s, d: sec.core_satellite(sec.core_returns(dense(s, d), sec.core_pool(dense(s, d), pools(s, d), 5, 120), START, END), rotated(s, d)).select("date", F.round("ret", 5).alias("ret")), "select c.date, round(case when r.ret is null then c.ret else 0.7 * c.ret + (1 - 0.7) * r.ret end, 5) as ret from core c left join rot r using (date_idx)", CORE)
add("join_pool_map", lambda s, d: panel.weekly_bars(s, d).select("code").distinct().join(sec.core_pool(dense(s, d), pools(s, d), 5, 120).select("code", "sector"), "code", "left").select("code", F.coalesce("sector", F.lit("other")).alias("sector")), "select b.code, coalesce(sector, 'other') as sector from (select distinct code from bars) b left join pool using (code)", f"{sql.BARS},\n{POOL}")
add("union_pools", lambda s, d: _union(s, d), "select code, min(k) as k from (select code, 0 as k from pool where rank <= 2 union all select code, 1 from inst where code like '600%') group by code", f"{sql.BARS},\n{POOL}")
add("intersect_index", lambda s, d: panel.weekly_bars(s, d).select("date").intersect(panel.table(s, d, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date"))), "select date from bars intersect select date_trunc('week', o_orderdate)::date from orders", sql.BARS)
add("union_first_per_code", lambda s, d: _first(s, d), "select code, doc, src from (select *, row_number() over (partition by code order by src, doc) as r from (select o_custkey as code, o_orderkey as doc, 0 as src from orders where o_orderkey % 3 = 0 union all select o_custkey, o_orderkey, 1 from orders where o_orderkey % 3 != 0)) where r = 1", "")
add("dedupe_last", lambda s, d: panel.table(s, d, "orders").groupBy(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date")).agg(F.max_by("o_totalprice", F.col("o_orderkey")).alias("amount")), "select o_custkey as code, o_orderdate::date as date, max_by(o_totalprice, o_orderkey) as amount from orders group by all", "")
add("dedupe_announcement", lambda s, d: tx.first_per_key(panel.table(s, d, "orders").select(F.col("o_custkey").alias("code"), "o_orderpriority", F.col("o_orderkey").alias("id")), ["code", "o_orderpriority"], "id"), "select o_custkey as code, o_orderpriority, min(o_orderkey) as id from orders group by all", "")
add("adj_close", lambda s, d: panel.weekly_bars(s, d).select("code", "date", (F.col("close") * (1 + F.col("volume") / 1000)).alias("adj")), "select code, date, close * (1 + volume / 1000) as adj from bars", sql.BARS)
add("plug_signal", lambda s, d: pf.top_k(PLUGINS["low_turn"](features(s, d)), 5).select("code", "date", F.col("rank").cast("long").alias("rank")), "select code, date, rank from (select *, row_number() over (partition by date_idx order by -turn desc, code) as rank from feat where turn is not null) where rank <= 5")
PLUGINS = {"low_turn": lambda df: df.withColumn("score", -F.col("turn")), "momentum": lambda df: df.withColumn("score", F.col("ret5"))}


def _union(spark, sf_dir) -> DataFrame:
    first = sec.core_pool(dense(spark, sf_dir), pools(spark, sf_dir), 5, 120).where("rank <= 2").select("code", F.lit(0).alias("k"))
    second = panel.instruments(spark, sf_dir).where("code like '600%'").select("code", F.lit(1).alias("k"))
    return first.unionByName(second).groupBy("code").agg(F.min("k").alias("k"))


def _first(spark, sf_dir) -> DataFrame:
    rows = panel.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(1).alias("src"))
    return tx.first_per_key(rows, ["code"], "src", "doc")


# --- snapshot of technical indicators ---------------------------------------------
def ema_macd(pdf: pd.DataFrame) -> pd.DataFrame:
    """Last MACD (12, 26, 9) of one code's traded rows: an order-dependent recursion."""
    x = pdf.sort_values("date_idx", kind="stable")["close"].dropna()
    fast, slow = x.ewm(span=12, adjust=False).mean(), x.ewm(span=26, adjust=False).mean()
    dif = fast - slow
    dea = dif.ewm(span=9, adjust=False).mean()
    return pd.DataFrame({"code": [pdf["code"].iloc[0]], "dif": [dif.iloc[-1] if len(x) else None], "dea": [dea.iloc[-1] if len(x) else None]})


def tech_snapshot(spark, sf_dir) -> DataFrame:
    f = features(spark, sf_dir)
    prev = F.lag("close").over(w.by_code())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    f = f.withColumn("tr", F.when(F.col("high").isNotNull(), tr)).withColumn("atr14", w.full(F.col("tr"), F.avg, 14))
    last = f.where("close is not null").groupBy("code").agg(F.max_by(F.struct("ma5", "ma10", "ma20", "ret5", "ret20", "atr14", "rsi6", "rsi14"), "date_idx").alias("x")).select("code", "x.*")
    macd = f.select("code", "date_idx", "close").groupBy("code").applyInPandas(ema_macd, "code string, dif double, dea double")
    return last.join(macd, "code").select("code", *[F.round(c, 4).alias(c) for c in ("ma5", "ma10", "ma20", "ret5", "ret20", "atr14", "rsi6", "rsi14", "dif", "dea")])


MACD = f"""traded as (select code, close, row_number() over (partition by code order by date_idx) as k from dense where close is not null),
rec as (select code, k, close as f, close as s, 0.0::double as dea from traded where k = 1
  union all select t.code, t.k, r.f + (t.close - r.f) * (2.0 / 13), r.s + (t.close - r.s) * (2.0 / 27), r.dea + ((r.f + (t.close - r.f) * (2.0 / 13) - r.s - (t.close - r.s) * (2.0 / 27)) - r.dea) * (2.0 / 10) from rec r join traded t on t.code = r.code and t.k = r.k + 1)"""
QUERIES["tech_snapshot"] = tech_snapshot
ORACLE_SQL["tech_snapshot"] = f"""with recursive {sql.FEATURES},
{MACD},
trs as (select *, case when high is not null then greatest(high - low, abs(high - lag(close) over {sql.W}), abs(low - lag(close) over {sql.W})) end as tr from feat),
atr as (select *, case when count(tr) over {sql.t(14)} >= 14 then avg(tr) over {sql.t(14)} end as atr14 from trs)
select code, {', '.join(f'round({c}, 4) as {c}' for c in ('ma5', 'ma10', 'ma20', 'ret5', 'ret20', 'atr14', 'rsi6', 'rsi14'))}, round(f - s, 4) as dif, round(dea, 4) as dea
from (select *, row_number() over (partition by code order by date_idx desc) as rn from atr where close is not null) a join (select code as c2, f, s, dea, row_number() over (partition by code order by k desc) as kk from rec) m on a.code = m.c2 and kk = 1 where rn = 1"""


# --- payload of the gate, rules as data -------------------------------------------------
def gate_payload(spark, sf_dir) -> DataFrame:
    """Top codes of the last signal day by hits, with score and probability from their combinations' means."""
    kept = patterns.keep(spark, sf_dir)
    rows = patterns.combo_scores(spark, sf_dir).where("score is not null")
    last = rows.where(F.col("date_idx") == rows.select(F.max("date_idx")).scalar())
    top = pf.top_k(last, 10).select("code", F.col("score").cast("long").alias("hits"), F.explode("kept_hits").alias("combo"))
    mean = top.join(kept.select("combo", "mean_5d"), "combo").groupBy("code", "hits").agg(F.avg("mean_5d").alias("m"))
    score = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 40 + 20 * F.col("hits") + 800 * F.greatest(F.col("m"), F.lit(0.0)))))
    return mean.select("code", "hits", score.alias("score100"), F.round(F.least(F.lit(85.0), F.greatest(F.lit(5.0), 50 + 1000 * F.col("m"))), 1).alias("prob"))


add("gate_topn_payload", gate_payload, """select code, n as hits, floor(least(100.0, greatest(0.0, 40 + 20 * n + 800 * greatest(m, 0.0))))::bigint as score100, round(least(85.0, greatest(5.0, 50 + 1000 * m)), 1) as prob from
  (select code, n, avg(mean_5d) as m from (select code, n, unnest(hits) as combo from (select f.code, f.hits, s.n, row_number() over (order by s.n desc, f.code) as rn from fwd f join scored s using (code, date_idx, date) where s.n > 0 and f.date_idx = (select max(date_idx) from scored where n > 0)) where rn <= 10) join keep using (combo) group by code, n)""", patterns.KEPT)  # fmt: skip
add("plug_rules", lambda s, d: _rules(s, d), "select r.name, count(*) as n from feat join (values ('up', 0.0, 0.05), ('jump', 0.05, 9.0), ('drop', -9.0, -0.05)) r(name, lo, hi) on ret1 > lo and ret1 <= hi group by r.name")


def _rules(spark, sf_dir) -> DataFrame:
    """Rules as a table (name, lo, hi): one generated expression per row of the rule table."""
    rules = [("up", 0.0, 0.05), ("jump", 0.05, 9.0), ("drop", -9.0, -0.05)]
    hits = F.filter(F.array(*[F.when((F.col("ret1") > lo) & (F.col("ret1") <= hi), F.lit(n)) for n, lo, hi in rules]), lambda x: x.isNotNull())
    return features(spark, sf_dir).select(F.explode(hits).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# --- sources and sinks over derived files --------------------------------------------
def column_bin(spark, sf_dir) -> DataFrame:
    """Closes written as one binary column file per code and read back with the calendar."""
    path = columns.scratch(spark, "columns")
    columns.write_columns(dense(spark, sf_dir), path)
    days = panel.calendar(panel.weekly_bars(spark, sf_dir))
    return columns.read_columns(spark, path).join(days, "date_idx").select("code", "date", F.col("value").cast("double").alias("close"))


add("src_column_bin", column_bin, "select code, date, close::float::double as close from bars", sql.BARS)


def instruments_tsv(spark, sf_dir) -> DataFrame:
    path = columns.scratch(spark, "instruments")
    bars = panel.weekly_bars(spark, sf_dir).groupBy("code").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    line = F.when(F.col("code").endswith("1"), F.col("code")).otherwise(F.concat_ws("\t", "code", "a", "b"))
    bars.select(line.alias("value")).write.text(path)
    return columns.read_instruments(spark, path)


add("src_instruments", instruments_tsv, "select code, case when code not like '%1' then a end as start, case when code not like '%1' then b end as stop from (select code, min(date) as a, max(date) as b from bars group by code)", sql.BARS)


def nav_csv(spark, sf_dir) -> DataFrame:
    path = columns.scratch(spark, "nav")
    rows = patterns.daily_turnover(spark, sf_dir).select("date", F.round("ret", 6).alias("ret"))
    rows.write.option("header", True).csv(path)
    return spark.read.schema("date date, ret double").option("header", True).csv(path)


add("sink_nav_csv", nav_csv, "select date, round(ret, 6) as ret from dport", patterns.D2)


def records(spark, sf_dir) -> DataFrame:
    """JSON records with junk and absent fields to a whitelisted, typed table."""
    o = panel.table(spark, sf_dir, "orders")
    raw = o.select(F.to_json(F.struct(F.lpad((F.col("o_custkey") % 1000000).cast("string"), 6, "0").alias("code"), F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.col("o_orderkey").cast("string")).alias("eps"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit(1).alias("noise"))).alias("json"))
    return columns.typed_records(raw, {"code": "string", "eps": "double", "day": "date", "absent": "double"})


add("src_records_whitelist", records, "select lpad((o_custkey % 1000000)::varchar, 6, '0') as code, case when o_orderkey % 4 != 0 then o_orderkey end::double as eps, o_orderdate::date as day, null::double as absent from orders", "")


def announcements(spark, sf_dir) -> DataFrame:
    """Nested announcements (codes and columns in arrays) to flat rows."""
    o = panel.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("codes"))
    raw = o.select(F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.transform("codes", lambda c: F.struct(c.cast("string").alias("code"), F.concat(F.lit("n"), c.cast("string")).alias("name"))).alias("codes"))).alias("json"))
    parsed = raw.select(F.from_json("json", "id long, codes array<struct<code: string, name: string>>").alias("r"))
    return parsed.select("r.id", F.inline("r.codes"))


add("src_json_records", announcements, "select distinct l_orderkey as id, l_suppkey::varchar as code, 'n' || l_suppkey as name from lineitem", "")


# --- model -------------------------------------------------------------------------------
FACTORS = ["ret1", "ret5", "ret10", "ret20", "vol20", "turn", "rsi6", "ma_gap"]
TRAIN_END, VALID_END, HORIZON = 160, 220, 5


def ml_scores(spark, sf_dir) -> DataFrame:
    """Scores of the rows after the validation segment, by trees fitted before it."""
    f = features(spark, sf_dir).withColumn("ma_gap", F.col("ma5") / F.col("ma20") - 1)
    f = w.forward_return(f, "close", HORIZON, "label")
    trees = model.fit(f, FACTORS, "label", TRAIN_END, VALID_END, HORIZON, columns.scratch(spark, "trees"))
    return model.score(f.where(F.col("date_idx") >= VALID_END), FACTORS, trees)


def ml_topk(spark, sf_dir) -> DataFrame:
    """The replay of the ten best names by a learned score, against all names."""
    days = trading_days(spark, sf_dir)
    last = days.agg(F.max("date_idx")).first()[0] or 0
    return model.nav(ml_scores(spark, sf_dir), dense(spark, sf_dir), days, VALID_END, last + 1, 10).drop("date_idx")


def ml_picks(spark, sf_dir) -> DataFrame:
    return pf.top_k(ml_scores(spark, sf_dir), 10).select("code", "date", F.col("rank").cast("long").alias("rank"))


add("ml_picks", ml_picks, None)
add("ml_topk", ml_topk, None)
