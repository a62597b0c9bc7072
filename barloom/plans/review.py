"""Queries of the daily review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import review as rv
from ..sources import panel
from . import sql
from .evaluate import DETECT, detect
from .windows import features

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(key: str, run, body: str, ctes: str = sql.FEATURES) -> None:
    QUERIES[key] = run
    ORACLE_SQL[key] = sql.with_(ctes, body)


def sectors(spark, sf_dir) -> DataFrame:
    return panel.instruments(spark, sf_dir).select("code", F.col("industry").alias("sector"))


LADDER = """lad as (select date_idx, date, count(*) filter (streak = 1) as first, count(*) filter (streak = 2) as second, count(*) filter (streak = 3) as third,
  coalesce(max(streak) filter (streak >= 4), 0)::int as top_boards, coalesce(first(code order by streak desc, code) filter (streak >= 4), '') as top_code,
  coalesce(array_to_string(list(code order by streak desc, code) filter (streak >= 4)[1:8], ','), '') as highs from feat group by date_idx, date)"""
PROMO = f"""promo as (select date_idx, date, count(*) filter (b >= 2 and is_limit) as num, count(*) filter (b >= 2) as den,
  round(case when count(*) filter (b >= 2) > 0 then count(*) filter (b >= 2 and is_limit) * 100.0::double / count(*) filter (b >= 2) else 0.0 end, 1) as rate
  from (select *, lag(streak) over {sql.W} as b from feat) group by date_idx, date)"""
PREM = f"""prem as (select date_idx, date, round(avg(p), 2) as avg, round(median(p), 2) as median, count(*) filter (p < -5) as big_face, count(p) as sample,
  coalesce(array_to_string(list(code order by p, code) filter (p < -5)[1:5], ','), '') as worst from (select *, case when b then ret1 * 100 end as p from (select *, lag(is_limit) over {sql.W} as b from feat)) group by date_idx, date)"""
SECT = """sect as (select * from (select *, row_number() over (partition by date_idx order by n desc, sector) as rank from
  (select date_idx, date, industry as sector, count(*) as n from feat join inst using (code) where is_limit group by all)) where rank <= 12)"""
add("ladder", lambda s, d: rv.ladder(features(s, d)).drop("date_idx"), "select date, first, second, third, top_boards, top_code, highs from lad", f"{sql.FEATURES},\n{LADDER}")
add("join_promotion", lambda s, d: rv.promotion(features(s, d)).drop("date_idx"), "select date, num, den, rate from promo", f"{sql.FEATURES},\n{PROMO}")
add("join_premium", lambda s, d: rv.premium(features(s, d)).drop("date_idx"), "select date, avg, median, big_face, sample, worst from prem", f"{sql.FEATURES},\n{PREM}")
add("sector_counts", lambda s, d: rv.sector_counts(features(s, d), sectors(s, d)).drop("date_idx"), "select date, sector, n, rank from sect", f"{sql.FEATURES},\n{SECT}")


def days(spark, sf_dir) -> DataFrame:
    """One row per date with every input of the score; all per-date tables are joined on date_idx."""
    f = features(spark, sf_dir)
    found = detect(spark, sf_dir)
    up, there = F.count_if(F.col("ret1") > 0), F.count("ret1")
    zb, zt = F.count_if("failed"), F.count_if("limit_up")
    stats = found.groupBy("date_idx", "date").agg(zt.alias("zt"), F.count_if("down").alias("dt"), F.round(F.when(zt + zb > 0, zb * 100.0 / (zt + zb)).otherwise(0.0), 1).alias("zb_rate"), F.round(F.when(there > 0, up * 100.0 / there), 2).alias("red_pct"), F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / 1e3, 4).alias("amount_yi"))
    stats = stats.withColumn("amount_delta", F.col("amount_yi") - F.lag("amount_yi").over(Window.orderBy("date_idx")))
    sect = rv.sector_counts(f, sectors(spark, sf_dir)).groupBy("date_idx").agg(F.max("n").alias("top_sector"), F.count("*").alias("n_sectors"))
    out = stats.join(rv.ladder(f).drop("date"), "date_idx").join(rv.promotion(f).drop("date"), "date_idx").join(rv.premium(f).drop("date"), "date_idx").join(sect, "date_idx", "left")
    return rv.emotion_score(out).withColumn("strong", (F.coalesce("top_sector", F.lit(0)) >= 10) & (F.col("total") >= 75))


SCORE = f"""{DETECT},
{LADDER},
{PROMO},
{PREM},
{SECT},
stats as (select *, amount_yi - lag(amount_yi) over (order by date_idx) as amount_delta from (select date_idx, date, count(*) filter (limit_up) as zt, count(*) filter (down) as dt,
  round(case when count(*) filter (limit_up or failed) > 0 then count(*) filter (failed) * 100.0::double / count(*) filter (limit_up or failed) else 0.0 end, 1) as zb_rate,
  round(count(*) filter (ret1 > 0) * 100.0::double / nullif(count(ret1), 0), 2) as red_pct, round(sum(amount::decimal(18,2))::double / 1e3, 4) as amount_yi from det group by date_idx, date)),
joined as (select stats.*, second, third, top_boards, rate, num, den, prem.avg, big_face, top_sector, n_sectors from stats join lad using (date_idx) join promo using (date_idx) join prem using (date_idx)
  left join (select date_idx, max(n) as top_sector, count(*) as n_sectors from sect group by date_idx) using (date_idx)),
parts as (select *,
  least(case when zt >= 80 then 12 when zt >= 50 then 8 when zt >= 30 then 5 else 2 end + case when dt <= 3 then 8 when dt <= 10 then 4 else 0 end
    + case when top_boards >= 5 and third >= 2 and second >= 5 then 5 when top_boards >= 3 and second >= 3 then 3 else 0 end, 25) as s1,
  case when rate >= 50 then 12 when rate >= 35 then 9 when rate >= 20 then 5 else 2 end + case when avg >= 3 then 8 when avg >= 1 then 5 when avg >= -1 then 2 else 0 end
    + case when big_face = 0 then 5 when big_face <= 3 then 2 else 0 end as s2_raw,
  least(case when red_pct is null then 0 when red_pct >= 60 then 12 when red_pct >= 50 then 8 when red_pct >= 40 then 4 else 1 end
    + case when zt > greatest(dt, 1) * 8 then 8 when zt > greatest(dt, 1) * 3 then 5 else 0 end, 20) as s3,
  least(case when amount_yi is null then 0 when amount_yi >= 18000 then 10 when amount_yi >= 12000 then 7 when amount_yi >= 8000 then 4 else 2 end
    + case when amount_delta is null then 4 when amount_delta > 500 then 8 when amount_delta > 0 then 5 when amount_delta > -800 then 3 else 0 end, 20) as s4,
  case when top_sector >= 8 then 6 when top_sector >= 5 then 4 when top_sector >= 3 then 2 else 0 end + case when n_sectors >= 4 then 4 when n_sectors >= 2 then 2 else 0 end as s5 from joined),
score as (select *, s1 + s2 + s3 + s4 + s5 as total, greatest(40, least(75, s1 + s2 + s3 + s4 + s5 - 10)) as base,
  coalesce(top_sector, 0) >= 10 and s1 + s2 + s3 + s4 + s5 >= 75 as strong from (select *, least(case when zb_rate >= 35 then greatest(s2_raw - 6, 0) else s2_raw end, 25) as s2 from parts))"""
REGIME_SQL = "case when total >= 75 and strong then 'attack' when total >= 65 then 'mixed, strong' when total >= 50 then 'mixed' when total >= 35 then 'ebb' else 'defence' end"
ANCHOR_SQL = "(case when total >= 75 and strong then 7.0 when total >= 70 then 5.0 when total >= 60 then case when strong then 4.0 else 3.0 end when total >= 45 then 2.0 else 1.0 end)::double"
add("emotion_score", lambda s, d: days(s, d).select("date", "s1", "s2", "s3", "s4", "s5", "total", "base"), "select date, s1, s2, s3, s4, s5, total, base from score", SCORE)
add("market_regime", lambda s, d: days(s, d).select("date", rv.market_regime(F.col("total"), F.col("strong")).alias("regime")), f"select date, {REGIME_SQL} as regime from score", SCORE)
add("position_anchor", lambda s, d: days(s, d).select("date", rv.position_anchor(F.col("total"), F.col("strong")).alias("anchor")), f"select date, {ANCHOR_SQL} as anchor from score", SCORE)


def macro(spark, sf_dir) -> DataFrame:
    """(as_of, position): a macro state per order month, as a gappy source."""
    o = panel.table(spark, sf_dir, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("as_of")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 0.9).otherwise(0.2)).alias("position"))
    return o


def blended(spark, sf_dir) -> DataFrame:
    """Each day with the latest macro state up to it: union and last value over dates, no range join."""
    day = days(spark, sf_dir).select("date", rv.position_anchor(F.col("total"), F.col("strong")).alias("anchor"), F.lit(None).cast("date").alias("as_of"), F.lit(None).cast("double").alias("position"))
    state = macro(spark, sf_dir).select(F.col("as_of").alias("date"), F.lit(None).cast("double").alias("anchor"), "as_of", "position")
    w = Window.orderBy("date", F.col("anchor").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = day.union(state).withColumn("as_of", F.last("as_of", ignorenulls=True).over(w)).withColumn("position", F.last("position", ignorenulls=True).over(w))
    return filled.where("anchor is not null").withColumn("b", rv.blend_anchor(F.col("anchor"), F.col("position"), F.col("as_of"), F.col("date")))


MACRO = f"""{SCORE},
macro as (select last_day(o_orderdate::date) as as_of, avg(case when o_orderstatus = 'F' then 0.9 else 0.2 end) as position from orders group by 1),
blend as (select s.date, s.anchor, m.as_of, m.position, case when m.position is null then 'missing' when s.date - m.as_of > 5 then 'stale' end as reason from
  (select date, {ANCHOR_SQL} as anchor from score) s asof left join macro m on s.date >= m.as_of),
coef as (select *, case when reason is not null then 1.0 else round(0.6 + 0.4 * greatest(0.0, least(position / 0.9, 1.0)), 4) end::double as coeff from blend)"""
add("join_asof_forecast_lag", lambda s, d: blended(s, d).select("date", "as_of", F.round("position", 6).alias("position")), "select date, as_of, round(position, 6) as position from blend", MACRO)
add("macro_coefficient", lambda s, d: macro(s, d).select("as_of", rv.macro_coefficient(F.col("position")).alias("coeff")), "select as_of, round(0.6 + 0.4 * greatest(0.0, least(position / 0.9, 1.0)), 4) as coeff from macro", MACRO)
add("blend_anchor", lambda s, d: blended(s, d).select("date", "b.final", "b.coeff", "b.reason"), "select date, greatest(1.0, least(round(anchor * coeff, 1), 7.0))::double as final, coeff, coalesce(reason, case when coeff >= 1 then 'full' end, '') as reason from coef", MACRO)
add("amount_caliber", lambda s, d: days(s, d).select("date", rv.pick_amount(F.col("amount_yi"), F.col("zt") % 2 == 0, F.col("amount_yi") / 2).alias("p")).select("date", "p.amount", "p.scope"), "select date, case when zt % 2 = 0 then amount_yi else amount_yi / 2 end as amount, case when zt % 2 = 0 then 'market' else 'index' end as scope from score", SCORE)
RULES = [("south", ["CHINA", "INDIA", "JAPAN"]), ("europe", ["FRANCE", "GERMANY", "RUSSIA"])]
add("classify_sector", lambda s, d: panel.instruments(s, d).select("code", rv.classify_sector(F.col("industry"), F.col("sector"), RULES).alias("class")), "select code, case when contains(industry, 'CHINA') or contains(industry, 'INDIA') or contains(industry, 'JAPAN') then 'south' when contains(industry, 'FRANCE') or contains(industry, 'GERMANY') or contains(industry, 'RUSSIA') then 'europe' else sector[1:8] end as class from inst", sql.BARS)
add("theme_levels", lambda s, d: rv.sector_counts(features(s, d), sectors(s, d), 6).select("date", "sector", "n", rv.theme_level(F.col("n")).alias("level")), "select date, sector, n, case when n >= 8 then 'A-' when n >= 5 then 'B+' when n >= 3 then 'B' else 'watch' end as level from sect where rank <= 6", f"{sql.FEATURES},\n{SECT}")


def leaders(spark, sf_dir) -> DataFrame:
    """Limit-ups with their date's highest streak and a risk grade."""
    f = features(spark, sf_dir).where("is_limit")
    top = F.col("streak") == F.max("streak").over(Window.partitionBy("date_idx"))
    return f.join(panel.instruments(spark, sf_dir), "code", "left").select("date", "code", "name", "sector", "streak", top.alias("top"), rv.leader_risk(F.col("amount") / 10, F.col("volume") * 1000, top).alias("risk"), "date_idx", "amount")


LEAD = f"""{sql.FEATURES},
lead as (select date, date_idx, code, name, sector, streak, top, amount, case when top then 'high' when coalesce(volume, 0) * 1000 <= 0 then 'unknown' when coalesce(amount, 0) / 10 / (volume * 1000) < 0.3 then 'high' else 'mid' end as risk from
  (select f.*, streak = max(streak) over (partition by date_idx) as top from feat f where is_limit) left join inst using (code))"""
add("leader_risk", lambda s, d: leaders(s, d).select("date", "code", "risk"), "select date, code, risk from lead", LEAD)
add("join_enrich_leaders", lambda s, d: leaders(s, d).select("date", "code", "name", "sector", "streak", "top"), "select date, code, name, sector, streak, top from lead", LEAD)
add("join_watch_pool", lambda s, d: panel.instruments(s, d).where("code like '%1'").join(leaders(s, d).select("date", "code", "streak"), "code", "left").select("code", "name", "date", "streak"), "select i.code, i.name, l.date, l.streak from inst i left join lead l using (code) where i.code like '%1'", LEAD)


def watched() -> Column:
    return F.col("code").endswith("1")


def traded(spark, sf_dir) -> DataFrame:
    """Features with the name and the industry of each code."""
    known = panel.instruments(spark, sf_dir).select("code", "name", "industry")
    columns = ["date_idx", "date", "code", "name", "industry", "streak", "is_limit", "amount", "close", "ma20", "ret5"]
    return features(spark, sf_dir).join(known, "code", "left").select(*columns)


def core_roles(spark, sf_dir) -> DataFrame:
    return rv.core_roles(traded(spark, sf_dir), watched()).drop("date_idx", "name")


def four_dim(spark, sf_dir) -> DataFrame:
    return rv.four_dim_scores(traded(spark, sf_dir), days(spark, sf_dir), watched()).drop("date_idx")


ROLES = """z as (select f.*, i.name, i.industry from feat f left join inst i using (code)),
secn as (select date_idx, industry, count(*) as n from z where is_limit group by all),
tops as (select date_idx, industry as top_sector, n as top_n from secn qualify row_number() over (partition by date_idx order by n desc, industry) = 1),
six as (select * from z where is_limit qualify row_number() over (partition by date_idx order by streak desc, amount desc nulls last, code) <= 6),
named as (select * from six qualify row_number() over (partition by date_idx, name order by streak desc, amount desc nulls last, code) = 1),
leads as (select *, row_number() over (partition by date_idx order by streak desc, amount desc nulls last, code) as r from named qualify r <= 5),
strong as (select z.*, row_number() over (partition by date_idx order by amount desc nulls last, code) as r from z join tops using (date_idx) where is_limit and industry = top_sector qualify r <= 4),
filling as (select z.*, row_number() over (partition by date_idx order by code) as r from z join tops using (date_idx) where code like '%1' and close >= ma20
  and (contains(top_sector, left(industry, 2)) or contains(industry, left(top_sector, 2))) and not exists (select 1 from strong s where s.date_idx = z.date_idx and s.name = z.name)),
mids as (select date, code, row_number() over (partition by date_idx order by kind, r, code) as k from (select *, 0 as kind from strong union all select *, 1 from filling) qualify k <= 5),
roles as (
  select date, code, 'leader' as role, r from leads
  union all select date, code, 'mid', k from mids
  union all select date, code, 'elastic', row_number() over (partition by date_idx order by amount desc nulls last, code) as r from z where is_limit and code[1:2] in ('30', '68') qualify r <= 5)"""
add("core_roles", core_roles, "select * from roles", f"{sql.FEATURES},\n{ROLES}")
_grade = lambda x: "case " + " ".join(f"when {x} >= {at} then '{name}'" for at, name in rv.GRADES) + " else 'D' end"
FOUR = f"""{SCORE},
{ROLES},
listed as (
  select date_idx, date, name, 0 as kind, r as k, 70.0 as theme, 85.0 as pos, 40.0 as flow, 55.0 as hold from leads where r = 1 and streak >= 4
  union all
  select date_idx, date, name, 1, r, least(90.0, case when industry = top_sector then 60.0 else 45.0 end + case when top_n >= 8 then 10.0 else 0.0 end), least(90.0, 35.0 + streak * 12), 45.0, 50.0
  from leads join tops using (date_idx) where r <= 4
  union all
  select date_idx, date, name, 2, row_number() over (partition by date_idx order by code),
    case when is_limit then least(95.0, theme + 20) else theme end, case when is_limit then 55.0 else 40.0 end,
    50.0 + case when close >= ma20 then 15.0 when close < ma20 then -10.0 else 0.0 end + case when ret5 > 0.03 then 10.0 else 0.0 end,
    50.0 + case when close >= ma20 then 15.0 else 0.0 end + case when ret5 < -0.05 then -10.0 else 0.0 end
  from (select z.*, case when n is not null then least(90.0, 40.0 + n * 5) else 50.0 end as theme from z left join secn using (date_idx, industry) where code like '%1' and close is not null)),
once as (select * from listed qualify row_number() over (partition by date_idx, name order by kind, k) = 1),
kept as (select *, row_number() over (partition by date_idx order by kind, k) as rank from once qualify rank <= 16),
dims as (select kept.*, greatest(0.0, least(100.0, (35 * theme + 30 * pos + 20 * flow + 15 * hold) / 100 - case when total is null then 4 when total < 50 then 8 when total < 65 then 4 else 0 end)) as g
  from kept left join (select date_idx, total from score) using (date_idx))"""
add("four_dim_score", four_dim, f"""select date, name, rank, {', '.join(f'{_grade(c)} as {c}' for c in ('theme', 'pos', 'flow', 'hold'))}, round(g, 1)::double as raw, {_grade('g')} as grade, {_grade('(theme + pos) / 2')} as elastic,
  case when g >= 75 then 'follow' when g >= 60 then 'watch' when g >= 45 then 'hold' else 'avoid' end as act from dims""", FOUR)
add("watch_note", lambda s, d: _note(features(s, d)), "select code, close, case when ma20 is null then 'unknown' when close >= ma20 then 'above' else 'below' end as note from (select *, row_number() over (partition by code order by date_idx desc) as rn from feat where close is not null) where rn = 1")


def _note(f: DataFrame) -> DataFrame:
    last = f.where("close is not null").groupBy("code").agg(F.max_by(F.struct("close", "ma20"), "date_idx").alias("x"))
    return last.select("code", F.col("x.close").alias("close"), F.when(F.col("x.ma20").isNull(), "unknown").when(F.col("x.close") >= F.col("x.ma20"), "above").otherwise("below").alias("note"))


def payload(spark, sf_dir) -> DataFrame:
    """One document per date: JSON of the score and its parts."""
    d = days(spark, sf_dir)
    return d.select("date", F.to_json(F.struct("total", "base", F.struct("s1", "s2", "s3", "s4", "s5").alias("dims"))).alias("json"))


add("sink_payload_json", payload, """select date, '{"total":' || total || ',"base":' || base || ',"dims":{"s1":' || s1 || ',"s2":' || s2 || ',"s3":' || s3 || ',"s4":' || s4 || ',"s5":' || s5 || '}}' as json from score""", SCORE)
