"""Sector features, sector scores and rotation replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .portfolio import block_of, next_return
from .windows import average_rank, by_code, full


def by_sector(n: int):
    return Window.partitionBy("sector").orderBy("date_idx").rowsBetween(-(n - 1), 0)


def core_pool(panel: DataFrame, sectors: DataFrame, n: int, lookback: int, by: str = "volume") -> DataFrame:
    """(sector, code, rank): the n members per sector with the largest mean of `by` over
    the last `lookback` rows of the panel."""
    last = panel.select(F.max("date_idx")).scalar()
    mean = panel.where(F.col("date_idx") > last - lookback).groupBy("code").agg(F.avg(by).alias("m")).where("m is not null").join(sectors, "code")
    w = Window.partitionBy("sector").orderBy(F.desc("m"), "code")
    return mean.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).select("sector", "code", "rank")


def sector_days(panel: DataFrame, sectors: DataFrame, momentum: int = 20, heat: int = 10) -> DataFrame:
    """(sector, date_idx, date, eq_ret, mom, heat): equal-weight return, its compounded
    rolling value, and rolling means of limit-ups plus large moves."""
    rows = panel.join(sectors.select("code", "sector"), "code").groupBy("sector", "date_idx", "date").agg(F.avg("ret1").alias("eq_ret"), (F.count_if("is_limit") + F.count_if("is_big")).cast("double").alias("hot"))
    m, h = by_sector(momentum), by_sector(heat)
    mom = F.when(F.count("eq_ret").over(m) >= momentum, F.product(1 + F.col("eq_ret")).over(m) - 1)
    return rows.withColumn("mom", mom).withColumn("heat", F.when(F.count("hot").over(h) >= heat, F.avg("hot").over(h))).drop("hot")


def emotion(panel: DataFrame, n: int = 10) -> DataFrame:
    """emotion: share of rows with a limit-up or large move in the last n; its 3-row
    change and cross-sectional rank."""
    hot = F.col("is_limit").cast("double") + F.col("is_big").cast("double")
    out = panel.withColumn("_hot", hot).withColumn("emotion", full(F.col("_hot"), F.sum, n) / n).drop("_hot")
    out = out.withColumn("emotion_chg", F.col("emotion") - F.lag("emotion", 3).over(by_code()))
    return out.withColumn("emotion_rank", average_rank("emotion", ["date_idx"]))


def pulse_score(panel: DataFrame, sectors: DataFrame) -> DataFrame:
    """score: .4 heat + .4 momentum - .1 volatility - .1 turnover in ranks, null where the
    name is overheated or its emotion falls fast. Of a code with several instruments the
    last ten rows are those by date, then sector."""
    p = emotion(panel).join(sectors.select("code", "sector"), "code")
    last = Window.partitionBy("code").orderBy("date_idx", "sector").rowsBetween(-9, 0)
    hot = p.withColumn("_h", F.sum(F.col("is_limit").cast("int") + F.col("is_big").cast("int")).over(last)).withColumn("_n", F.count("*").over(last))
    heat = F.avg(F.when(F.col("_n") >= 10, F.col("_h"))).over(Window.partitionBy("sector", "date_idx"))
    hot = hot.withColumn("stock_heat", heat)
    r = lambda e: average_rank(e, ["date_idx"])
    score = 0.4 * r(F.col("stock_heat")) + 0.4 * r(F.col("ret20")) + 0.1 * r(-F.col("vol20")) + 0.1 * r(-F.col("turn"))
    hot = hot.withColumn("_s", score)
    return hot.withColumn("score", F.when((F.col("emotion_rank") < 0.95) & (F.col("emotion_chg") >= -0.15), F.col("_s"))).drop("_s", "_h", "_n")


def sector_rank(days: DataFrame) -> DataFrame:
    """days with place: 1 for the strongest by .6 momentum rank + .4 heat rank (ties: sector)."""
    w = Window.partitionBy("date_idx")
    down = lambda c: F.rank().over(w.orderBy(F.desc_nulls_last(c))) + (F.count("*").over(Window.partitionBy("date_idx", c)) - 1) / 2
    rows = days.where("mom is not null and heat is not null").withColumn("_s", 0.6 * down("mom") + 0.4 * down("heat"))
    return rows.withColumn("place", F.row_number().over(w.orderBy("_s", "sector"))).drop("_s")


def rotation(days: DataFrame, start: int, end: int, rebalance: int, weights=(0.5, 0.3, 0.2), cost_bps: float = 12.0) -> DataFrame:
    """(date_idx, date, ret): at each block's first row the strongest sectors get the
    weights in order, kept for the block; returns are the next row's equal-weight ones."""
    ranked = sector_rank(days).where((F.col("date_idx") >= start) & (F.col("date_idx") < end) & ((F.col("date_idx") - start) % rebalance == 0) & (F.col("place") <= len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place"))
    held = ranked.select("sector", block_of(start, rebalance).alias("block"), weight.alias("weight"))
    nxt = days.withColumn("next", F.lead("eq_ret").over(Window.partitionBy("sector").orderBy("date_idx"))).where((F.col("date_idx") >= start) & (F.col("date_idx") < end))
    rows = nxt.select("sector", "date_idx", "date", "next", block_of(start, rebalance).alias("block")).join(held, ["sector", "block"])
    cost = F.when((F.col("date_idx") - start) % rebalance == 0, cost_bps / 10000.0).otherwise(0.0)
    return rows.groupBy("date_idx", "date").agg(F.sum(F.col("weight") * F.coalesce("next", F.lit(0.0))).alias("r")).select("date_idx", "date", (F.col("r") - cost).alias("ret"))


def core_satellite(core: DataFrame, satellite: DataFrame, base: float = 0.7) -> DataFrame:
    """base x core + (1 - base) x satellite per date; without a satellite return the core alone."""
    s = satellite.select("date_idx", F.col("ret").alias("sat"))
    return core.join(s, "date_idx", "left").select("date_idx", "date", F.when(F.col("sat").isNull(), F.col("ret")).otherwise(base * F.col("ret") + (1 - base) * F.col("sat")).alias("ret"))


def core_returns(panel: DataFrame, pool: DataFrame, start: int, end: int) -> DataFrame:
    """(date_idx, date, ret): equal-weight next-row return of a pool."""
    rows = next_return(panel).where((F.col("date_idx") >= start) & (F.col("date_idx") < end)).join(pool.select("code").distinct(), "code", "left_semi")
    return rows.groupBy("date_idx", "date").agg(F.coalesce(F.avg("next_ret"), F.lit(0.0)).alias("ret"))
