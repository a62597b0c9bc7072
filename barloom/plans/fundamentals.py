"""Queries of fundamentals, forecasts and the two composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalar as sc
from ..sources import panel
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(key: str, run, body: str | None, ctes: str = "") -> None:
    QUERIES[key] = run
    if body:
        ORACLE_SQL[key] = sql.with_(ctes, body) if ctes else body


T = panel.table

# --- fundamentals and scores ----------------------------------------------------------
FIN = """fin as (select *, (rev / lag(rev, 4) over (partition by code order by q) - 1) * 100 as yoy from
  (select l_suppkey as code, date_trunc('quarter', l_shipdate)::date as q, sum(l_extendedprice::decimal(18,2))::double as rev from lineitem group by all)),
eps as (select code, year(q)::int as year, sum(rev) as eps from fin group by all)"""


def financials(spark, sf_dir) -> DataFrame:
    rows = T(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("q")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("rev"))
    return rows.withColumn("yoy", (F.col("rev") / F.lag("rev", 4).over(Window.partitionBy("code").orderBy("q")) - 1) * 100)


def sue(fin: DataFrame, least: int = 6) -> DataFrame:
    """(code, sue): z of the latest yoy against the code's own earlier ones."""
    rows = fin.where("yoy is not null").withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("q"))))
    past = F.when(F.col("_r") > 1, F.col("yoy"))
    out = rows.groupBy("code").agg(F.count("*").alias("n"), F.max(F.when(F.col("_r") == 1, F.col("yoy"))).alias("last"), F.avg(past).alias("m"), F.stddev_samp(past).alias("sd"))
    return out.where((F.col("n") >= least) & (F.col("sd") > 0)).select("code", ((F.col("last") - F.col("m")) / F.col("sd")).alias("sue"))


def tightness(fin: DataFrame, implied) -> DataFrame:
    """(code, tightness): the implied growth against the mean of the last two yoy."""
    rows = fin.where("yoy is not null").withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("q")))).where("_r <= 2")
    avg = rows.groupBy("code").agg((F.avg("yoy") / 100).alias("a"))
    g = implied
    return avg.select("code", F.when(g > F.col("a") * 1.15, "above").when(g < F.col("a") * 0.75, "below").otherwise("near").alias("tightness"))


SUE = "sue as (select code, (last - m) / sd as sue from (select code, count(*) as n, max(yoy) filter (r = 1) as last, avg(yoy) filter (r > 1) as m, stddev_samp(yoy) filter (r > 1) as sd from (select *, row_number() over (partition by code order by q desc) as r from fin where yoy is not null) group by code) where n >= 6 and sd > 0)"
TIGHT = "tight as (select code, case when 0.1 > a * 1.15 then 'above' when 0.1 < a * 0.75 then 'below' else 'near' end as tightness from (select code, avg(yoy) / 100 as a from (select *, row_number() over (partition by code order by q desc) as r from fin where yoy is not null) where r <= 2 group by code))"
add("sue_proxy", lambda s, d: sue(financials(s, d)).select("code", F.round("sue", 6).alias("sue")), "select code, round(sue, 6) as sue from sue", f"{FIN},\n{SUE}")
add("tightness", lambda s, d: tightness(financials(s, d), F.lit(0.1)), "select * from tight", f"{FIN},\n{TIGHT}")


def consensus(spark, sf_dir) -> DataFrame:
    """One row per code with YEAR1..4 and EPS1..4, as the source lays it out."""
    eps = financials(spark, sf_dir).groupBy("code", F.year("q").alias("year")).agg(F.sum("rev").alias("eps"))
    rows = eps.where("year between 1997 and 2000").groupBy("code").pivot("year", [1997, 1998, 1999, 2000]).agg(F.first("eps"))
    return rows.select("code", *[x for i, y in enumerate((1997, 1998, 1999, 2000), 1) for x in (F.lit(y).alias(f"YEAR{i}"), F.col(str(y)).alias(f"EPS{i}"))])


def unpivoted(wide: DataFrame) -> DataFrame:
    return wide.select("code", F.explode(F.arrays_zip(F.array(*[f"YEAR{i}" for i in range(1, 5)]).alias("year"), F.array(*[f"EPS{i}" for i in range(1, 5)]).alias("eps"))).alias("x")).select("code", "x.year", "x.eps").where("year is not null and eps is not null")


def consensus_growth(wide: DataFrame, year: int) -> DataFrame:
    now, before = (F.max(F.when(F.col("year") == y, F.col("eps"))) for y in (year, year - 1))
    return unpivoted(wide).groupBy("code").agg(now.alias("a"), before.alias("b")).where("a is not null and b is not null and b != 0").select("code", ((F.col("a") - F.col("b")) / F.abs("b")).alias("growth"))


GROWTH = "growth as (select code, (a - b) / abs(b) as growth from (select code, max(eps) filter (year = 2000) as a, max(eps) filter (year = 1999) as b from eps group by code) where a is not null and b is not null and b != 0)"
add("src_forecast_unpivot", lambda s, d: unpivoted(consensus(s, d)).select("code", "year", F.round("eps", 2).alias("eps")), "select code, year, round(eps, 2) as eps from eps where year between 1997 and 2000", FIN)
add("consensus_growth", lambda s, d: consensus_growth(consensus(s, d), 2000).select("code", F.round("growth", 6).alias("growth")), "select code, round(growth, 6) as growth from growth", f"{FIN},\n{GROWTH}")
add("revision_1m", lambda s, d: _revision(s, d), "select code, round((a - b) / abs(b), 6) as revision from (select code, min_by(eps, year) as a, min_by(eps * (1 + (code % 7 - 3) / 10.0), year) as b from eps where year >= 1999 group by code) where b != 0", FIN)
add("rating_window_pick", lambda s, d: T(s, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("code"), "l_linenumber").agg(F.count("*").alias("n")).groupBy("code").agg(F.min_by("n", F.struct(F.col("l_linenumber") != 1, "l_linenumber")).alias("orgs")), "select code, min_by(n, ln) as orgs from (select l_suppkey as code, l_linenumber as ln, count(*) as n from lineitem where l_linenumber <= 4 group by all) group by code")


def _revision(spark, sf_dir) -> DataFrame:
    """(eps - last month) / |last month| of the nearest forecast year from 1999 on."""
    rows = unpivoted(consensus(spark, sf_dir)).where("year >= 1999").withColumn("was", F.col("eps") * (1 + (F.col("code") % 7 - 3) / 10.0))
    near = rows.groupBy("code").agg(F.min_by("eps", "year").alias("a"), F.min_by("was", "year").alias("b"))
    return near.where("b != 0").select("code", F.round((F.col("a") - F.col("b")) / F.abs("b"), 6).alias("revision"))


A_SQL = """case when w > 0 then round(t / w * 100, 1) else 0.0 end as score, n, n >= 2 as rankable from (select *,
  case when rev is not null then 0.40 else 0.0 end + case when sue is not null then 0.35 else 0.0 end + case when gap is not null then 0.25 else 0.0 end as w,
  case when rev is not null then 0.40 * greatest(0.0, least(rev / 0.2, 1.0)) else 0.0 end + case when sue is not null then 0.35 * greatest(0.0, least((sue + 2.0) / 4.0, 1.0)) else 0.0 end + case when gap is not null then 0.25 * greatest(0.0, least((gap + 0.2) / 0.4, 1.0)) else 0.0 end as t,
  (rev is not null)::int + (sue is not null)::int + (gap is not null)::int as n from parts)"""
PARTS = f"""{FIN},
{SUE},
{GROWTH},
parts as (select s_suppkey as code, case when s_suppkey % 3 != 0 then round(sue / 10, 3) end as rev, round(sue, 3) as sue, round(0.1 - growth, 3) as gap from supplier left join sue on s_suppkey = sue.code left join growth on s_suppkey = growth.code)"""


def score_parts(spark, sf_dir) -> DataFrame:
    """(code, rev, sue, gap): all suppliers with what is known of each."""
    base = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"))
    rows = base.join(sue(financials(spark, sf_dir)), "code", "left").join(consensus_growth(consensus(spark, sf_dir), 2000), "code", "left")
    return rows.select("code", F.when(F.col("code") % 3 != 0, sc.half_up(F.col("sue") / 10, 3)).alias("rev"), sc.half_up(F.col("sue"), 3).alias("sue"), sc.half_up(0.1 - F.col("growth"), 3).alias("gap"))


add("score_a", lambda s, d: score_parts(s, d).select("code", sc.score_a(F.col("rev"), F.col("sue"), F.col("gap")).alias("x")).select("code", "x.*"), f"select code, {A_SQL}", PARTS)
B_IN = "bin as (select s_suppkey as code, s_suppkey % 6 as level, case s_suppkey % 3 when 0 then 'net profit' when 1 then 'output' else 'revenue' end as metric, coalesce(tightness, 'unknown') as tightness, s_suppkey % 9 as traps, s_suppkey % 4 as soft, case when s_suppkey % 5 = 0 then 'subsidiary' else 'company' end as scheme, case when s_suppkey % 7 = 0 then 'or' else 'and' end as connector from supplier left join tight on code = s_suppkey)"
B_SQL = """round((0.6 * least(level / 5.0, 1.0) + 0.2 * case when metric like '%profit%' then 1.0 else 0.0 end + 0.1 * greatest(0.0, least(1 - pen / 100, 1.0)) + case tightness when 'above' then 0.1 when 'near' then 0.07 when 'below' then 0.02 else 0.0 end) / case when tightness in ('above', 'near', 'below') then 1.0 else 0.9 end * 100, 1) as score
from (select *, least(30.0, traps * 3.0) + least(20.0, soft * 5.0) + case when scheme = 'subsidiary' then 10.0 else 0.0 end + case when connector = 'or' then 5.0 else 0.0 end + case when metric in ('other', 'output', 'line') then 10.0 else 0.0 end as pen from bin)"""


def b_inputs(spark, sf_dir) -> DataFrame:
    base = T(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code")).join(tightness(financials(spark, sf_dir), F.lit(0.1)), "code", "left")
    k = F.col("code")
    metric = F.when(k % 3 == 0, "net profit").when(k % 3 == 1, "output").otherwise("revenue")
    return base.select("code", (k % 6).alias("level"), metric.alias("metric"), F.coalesce("tightness", F.lit("unknown")).alias("tightness"), (k % 9).alias("traps"), (k % 4).alias("soft"), F.when(k % 5 == 0, "subsidiary").otherwise("company").alias("scheme"), F.when(k % 7 == 0, "or").otherwise("and").alias("connector"))


def b_scores(spark, sf_dir) -> DataFrame:
    c = F.col
    return b_inputs(spark, sf_dir).select("code", sc.score_b(c("level"), c("metric"), F.array("metric"), c("tightness"), c("traps"), c("soft"), c("scheme"), c("connector")).alias("score"))


add("score_b", b_scores, f"select code, {B_SQL}", f"{FIN},\n{TIGHT},\n{B_IN}")
