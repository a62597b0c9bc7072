"""Portfolio replays in closed form, and statistics of their results.

A replay never loops over days: blocks of `rebalance` rows are numbered, each
block's holdings are the top K of its first row with a signal, and the block's
later rows join them. What crosses the driver is nothing; per-day results are
one row per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import half_up
from .windows import by_code


def top_k(scores: DataFrame, k: int, by: tuple = ("date_idx",), ascending: bool = False, digits: int | None = None) -> DataFrame:
    """The k best rows per date (ties: code); null scores are skipped. With digits, scores
    that are equal to so many digits tie: sums of the same parts differ in their last bits."""
    score = F.col("score") if digits is None else half_up(F.col("score"), digits)
    order = score.asc() if ascending else score.desc()
    ranked = scores.where("score is not null").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "code")))
    return ranked.where(F.col("rank") <= k)


def next_return(panel: DataFrame) -> DataFrame:
    """next_ret: raw ratio of the next calendar row's close to this one's."""
    return panel.withColumn("next_ret", F.lead("close").over(by_code()) / F.col("close") - 1)


def block_of(start: int, rebalance: int) -> Column:
    return F.floor((F.col("date_idx") - start) / rebalance)


def holdings(scores: DataFrame, start: int, end: int, k: int, rebalance: int, ascending: bool = False) -> DataFrame:
    """(block, pick_idx, code): top k of the first row of each block that has a signal."""
    inside = scores.where((F.col("date_idx") >= start) & (F.col("date_idx") < end) & F.col("score").isNotNull()).withColumn("block", block_of(start, rebalance))
    first = inside.groupBy("block").agg(F.min("date_idx").alias("pick_idx"))
    picked = inside.join(first, "block").where(F.col("date_idx") == F.col("pick_idx"))
    return top_k(picked, k, ("block",), ascending).select("block", "pick_idx", "code")


def replay(scores: DataFrame, panel: DataFrame, days: DataFrame, start: int, end: int, k: int, rebalance: int, cost_bps: float = 15.0, gate: DataFrame | None = None, frozen: bool = True) -> DataFrame:
    """(date_idx, date, ret, n_hold) for each day of [start, end).

    Holdings are picked at the first row of a block with a signal and kept to
    the block's end; the cost is charged on block rows with holdings; a gate
    (date_idx, gate) scales the day's return after cost, with its value at the
    pick (frozen) or of the day itself. Days without holdings return 0.
    """
    held = holdings(scores, start, end, k, rebalance)
    prices = next_return(panel).where((F.col("date_idx") >= start) & (F.col("date_idx") < end)).select("code", "date_idx", "next_ret", block_of(start, rebalance).alias("block"))
    rows = prices.join(held, ["block", "code"]).where(F.col("date_idx") >= F.col("pick_idx"))
    daily = rows.groupBy("date_idx", "pick_idx").agg(F.avg("next_ret").alias("mean"), F.count("*").alias("n_hold"))
    cost = F.when((F.col("date_idx") - start) % rebalance == 0, cost_bps / 10000.0).otherwise(0.0)
    value = F.col("mean") - cost
    if gate is not None:
        g = gate.select(F.col("date_idx").alias("g_idx"), "gate")
        daily = daily.join(g, F.col("pick_idx" if frozen else "date_idx") == F.col("g_idx"), "left")
        value = value * F.coalesce("gate", F.lit(1.0))
    daily = daily.select("date_idx", value.alias("ret"), "n_hold")
    span = days.where((F.col("date_idx") >= start) & (F.col("date_idx") < end))
    return span.join(daily, "date_idx", "left").select("date_idx", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("n_hold", F.lit(0)).alias("n_hold"))


def replay_daily(scores: DataFrame, panel: DataFrame, days: DataFrame, start: int, end: int, k: int, cost_bps: float = 15.0) -> DataFrame:
    """(date_idx, date, ret, turnover): daily top k with cost by turnover.

    turnover is |A symmetric difference B| / max(|A|, 1) against the previous
    day that had a signal, 1 for the first; days without a signal return 0.
    """
    inside = scores.where((F.col("date_idx") >= start) & (F.col("date_idx") < end))
    picks = top_k(inside, k).select("date_idx", "code")
    signal_days = picks.select("date_idx").distinct().withColumn("before", F.lag("date_idx").over(Window.orderBy("date_idx")))
    now = picks.join(signal_days, "date_idx")
    back = picks.select(F.col("date_idx").alias("before"), "code", F.lit(1).alias("kept"))
    same = now.join(back, ["before", "code"], "left").groupBy("date_idx", "before").agg(F.count("*").alias("n"), F.count("kept").alias("both"))
    size = picks.groupBy(F.col("date_idx").alias("before")).agg(F.count("*").alias("n_before"))
    same = same.join(size, "before", "left")
    turnover = F.when(F.col("before").isNull(), 1.0).otherwise((F.col("n") + F.col("n_before") - 2 * F.col("both")) / F.greatest(F.col("n"), F.lit(1)))
    ret = picks.join(next_return(panel).select("date_idx", "code", "next_ret"), ["date_idx", "code"]).groupBy("date_idx").agg(F.avg("next_ret").alias("mean"))
    daily = same.select("date_idx", turnover.alias("turnover")).join(ret, "date_idx")
    span = days.where((F.col("date_idx") >= start) & (F.col("date_idx") < end))
    value = F.coalesce(F.col("mean") - F.col("turnover") * cost_bps / 10000.0, F.lit(0.0))
    return span.join(daily, "date_idx", "left").select("date_idx", "date", value.alias("ret"), F.when(F.col("mean").isNotNull(), F.col("turnover")).otherwise(0.0).alias("turnover"))


def nav_stats(rets: DataFrame, by: tuple = ()) -> DataFrame:
    """days, nav, ann, max_dd, vol, sharpe, win over rows(date_idx, ret), one row per
    series; one series has one row per date, so its window is small."""
    w = Window.partitionBy(*by).orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)
    nav = rets.withColumn("nav", F.product(F.col("ret") + 1).over(w))
    nav = nav.withColumn("peak", F.max("nav").over(w))
    out = nav.groupBy(*by).agg(
        F.count("*").alias("days"), F.max_by("nav", "date_idx").alias("nav"), F.min(F.col("nav") / F.col("peak") - 1).alias("max_dd"),
        (F.stddev_pop("ret") * 252 ** 0.5).alias("vol"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * 252 ** 0.5).alias("sharpe"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win"),
    )
    return out.withColumn("ann", F.pow("nav", F.lit(252.0) / F.col("days")) - 1)


def breadth_gate(panel: DataFrame, n: int = 5, low: float = 0.35, mid: float = 0.45) -> DataFrame:
    """(date_idx, gate) from the n-row mean share of rising codes among those with a return."""
    by = panel.groupBy("date_idx").agg((F.count_if(F.col("ret1") > 0) / F.greatest(F.count("ret1"), F.lit(1))).alias("red"))
    mean = F.avg("red").over(Window.orderBy("date_idx").rowsBetween(-(n - 1), 0))
    return by.withColumn("red_ma", mean).select("date_idx", "red_ma", F.when(F.col("red_ma") < low, 0.30).when(F.col("red_ma") < mid, 0.60).otherwise(1.0).alias("gate"))


def market_gate(panel: DataFrame, warm: int = 60, n: int = 20) -> DataFrame:
    """(date_idx, gate) from 20-row means of the share of rising codes (of all codes
    of the panel) and of the number of limit-ups; 1 while warming up."""
    names = panel.select("code").distinct().agg(F.count("*").alias("names")).select("names").scalar()
    by = panel.groupBy("date_idx").agg(F.count_if(F.col("ret1") > 0).alias("up"), F.count_if("is_limit").alias("limits"))
    w = Window.orderBy("date_idx").rowsBetween(-(n - 1), 0)
    by = by.withColumn("red", F.avg("up").over(w) / names).withColumn("zt", F.avg("limits").over(w))
    gate = F.when(F.col("date_idx") < warm, 1.0).when((F.col("red") < 0.28) & (F.col("zt") < 1.5), 0.25).when((F.col("red") < 0.38) & (F.col("zt") < 2.5), 0.6).otherwise(1.0)
    return by.select("date_idx", gate.alias("gate"))


def turnover_annual(positions: DataFrame, periods: int = 252) -> DataFrame:
    """Sum of absolute changes of the non-null positions per year of `periods` rows; under two: null."""
    rows = positions.where("position is not null").withColumn("change", F.abs(F.col("position") - F.lag("position").over(Window.partitionBy("series_id").orderBy("date_idx"))))
    n = F.count("*")
    return rows.groupBy("series_id").agg(F.when(n >= 2, F.sum("change") / (n / periods)).alias("turnover"))
