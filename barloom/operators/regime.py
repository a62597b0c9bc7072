"""Regime of a market series: rate and valuation scores, states, positions, timing.

Rows are (series_id, date_idx, date, ...); every window is within a series, so
many series run in parallel and one series is never spread.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def in_series():
    return Window.partitionBy("series_id").orderBy("date_idx")


def asof_fill(series: DataFrame, rates: DataFrame) -> DataFrame:
    """series with the last past rate (rates: series_id, date, rate; of several on a
    date the last by `seq`): a union and one window, since Spark has no as-of join."""
    last = rates.groupBy("series_id", "date").agg(F.max_by("rate", "seq").alias("rate"))
    both = series.select("*", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("_own")).unionByName(last.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("date", "_own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rate", F.last("rate", ignorenulls=True).over(w)).where("_own = 1").drop("_own")


def rolling_z(value: Column, n: int = 252, least: int = 60) -> Column:
    w = in_series().rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp(value).over(w)
    return F.when((F.count(value).over(w) >= least) & (sd != 0), (value - F.avg(value).over(w)) / sd)


def rolling_percentile(rows: DataFrame, value: str, n: int = 1260, least: int = 120, name: str = "pctile") -> DataFrame:
    """Share of the window's values below the current one; a sorted window kept by
    binary search, one pass per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date_idx", kind="stable")
        x = pdf[value].to_numpy(float)
        out = np.full(len(x), np.nan)
        held = np.zeros(0)
        for i, v in enumerate(x):
            held = np.insert(held, np.searchsorted(held, v), v)
            if i >= n:
                held = np.delete(held, np.searchsorted(held, x[i - n]))
            if len(held) >= least:
                out[i] = np.searchsorted(held, v, "left") / len(held)
        return pdf.assign(**{name: out})

    schema = rows.withColumn(name, F.lit(None).cast("double")).schema
    return rows.groupBy("series_id").applyInPandas(run, schema).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def expanding_quantiles(rows: DataFrame, value: str, shares: dict[str, float], least: int = 60) -> DataFrame:
    """A column per share: linear quantile of the non-null values up to each row, null
    until `least` are known. A sorted list kept by binary search, one pass per
    series; an ordered percentile window would take the square of its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date_idx", kind="stable")
        held: list[float] = []
        out: dict[str, list[float]] = {name: [] for name in shares}
        for v in pdf[value].to_numpy(float):
            if not np.isnan(v):
                bisect.insort(held, v)
            for name, q in shares.items():
                if len(held) < least:
                    out[name].append(np.nan)
                    continue
                at = q * (len(held) - 1)
                lo = int(at)
                hi = min(lo + 1, len(held) - 1)
                out[name].append(held[lo] + (at - lo) * (held[hi] - held[lo]))
        return pdf.assign(**out)

    schema = rows.withColumns({n: F.lit(None).cast("double") for n in shares}).schema
    return rows.groupBy("series_id").applyInPandas(run, schema).withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in shares})


def tri_state(rows: DataFrame, score: str, least: int = 60, lo: float = 0.33, hi: float = 0.67) -> DataFrame:
    """q_lo, q_hi and state from the score's own past (expanding linear quantiles);
    null until `least` scores are known, never a state by default."""
    out = expanding_quantiles(rows, score, {"q_lo": lo, "q_hi": hi}, least)
    s = F.col(score)
    return out.withColumn("state", F.when(s >= F.col("q_hi"), "value").when(s >= F.col("q_lo"), "mood").when(s < F.col("q_lo"), "defence"))


def momentum_gate(momentum: Column) -> Column:
    return F.when(momentum > 0, 1.0).when(momentum > -0.05, 0.6).when(momentum.isNotNull(), 0.3)


def deadband_hold(rows: DataFrame, signal: str, every: int = 5, band: float = 0.30, name: str = "position") -> DataFrame:
    """The signal on every `every`-th row of the series, held until one differs by
    `band` or more: a fold in row order, one pass per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date_idx", kind="stable")
        now, out = np.nan, []
        for i, s in enumerate(pdf[signal].to_numpy(float)):
            if i % every == 0 and np.isfinite(s) and (not np.isfinite(now) or abs(s - now) >= band):
                now = s
            out.append(now)
        return pdf.assign(**{name: out})

    schema = rows.withColumn(name, F.lit(None).cast("double")).schema
    return rows.groupBy("series_id").applyInPandas(run, schema).withColumn(name, F.when(~F.isnan(name), F.col(name)))


def regime(series: DataFrame, rates: DataFrame, window: int = 1260) -> DataFrame:
    """Score, state and gate of each row of series(series_id, date_idx, date, value)."""
    w = in_series()
    out = asof_fill(series, rates).withColumn("rate_chg", F.col("rate") - F.lag("rate", 20).over(w))
    out = rolling_percentile(out, "value", window, name="val_pct")
    out = out.withColumn("rate_bull", -rolling_z(F.col("rate_chg")))
    out = out.withColumn("score", 0.5 * F.col("rate_bull") - 0.5 * (F.col("val_pct") - 0.5))
    out = tri_state(out, "score").withColumn("mom20", F.col("value") / F.lag("value", 20).over(w) - 1)
    base = F.when(F.col("state") == "value", 0.9).when(F.col("state") == "mood", 0.7).when(F.col("state") == "defence", 0.4)
    return out.withColumn("gate", momentum_gate(F.col("mom20"))).withColumn("signal", base * F.col("gate"))


def timing_nav(rows: DataFrame, position: str = "position") -> DataFrame:
    """(series_id, days, nav, bench): strategy by the previous row's position against
    the series itself, over rows with both positions."""
    w = in_series()
    r = rows.withColumn("_r", F.col("value") / F.lag("value").over(w) - 1).withColumn("_p", F.lag(position).over(w)).where(F.col(position).isNotNull() & F.col("_p").isNotNull() & F.col("_r").isNotNull())
    return r.groupBy("series_id").agg(F.count("*").alias("days"), F.product(1 + F.col("_p") * F.col("_r")).alias("nav"), F.product(1 + F.col("_r")).alias("bench"))
