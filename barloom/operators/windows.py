"""Rolling, ranking and run-length features over dense panels.

All windows of one panel share the specification (code, date_idx), so a query
pays one shuffle by code whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

def by_code():
    return Window.partitionBy("code").orderBy("date_idx")


def by_date():
    return Window.partitionBy("date_idx")


def trailing(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def padded(value: str) -> Column:
    """The last value seen up to this row."""
    return F.last(value, ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def pct_change(panel: DataFrame, value: str, n: int, name: str, pad: bool = True) -> DataFrame:
    """n-row return; with pad a missing value counts as the last one seen."""
    if not pad:
        return panel.withColumn(name, F.col(value) / F.lag(value, n).over(by_code()) - 1)
    filled = f"_{name}_filled"
    out = panel.withColumn(filled, padded(value))
    return out.withColumn(name, F.col(filled) / F.lag(filled, n).over(by_code()) - 1).drop(filled)


def full(value: Column, agg, n: int, least: int | None = None) -> Column:
    """agg(value) over n rows, null unless `least` (all n) of them are present."""
    return F.when(F.count(value).over(trailing(n)) >= (least or n), agg(value).over(trailing(n)))


def rolling_mean(value: str, n: int, least: int | None = None) -> Column:
    return full(F.col(value), F.avg, n, least)


def rolling_std(value: str, n: int, least: int | None = None) -> Column:
    return full(F.col(value), F.stddev_samp, n, least)


def daily_limit(code: Column) -> Column:
    """Daily limit in percent by board: 29.8, 19.8 or 9.8."""
    head = F.substring(code, 1, 2)
    return F.when(F.substring(code, 1, 1).isin("8", "4"), 29.8).when(head.isin("30", "68"), 19.8).otherwise(9.8)


def limit_flags(panel: DataFrame, ret: str = "ret1", tol: float = 0.002, big: float = 0.05) -> DataFrame:
    """is_limit: return within tol of the board's limit or above; is_big: return of `big` or more."""
    limit = daily_limit(F.col("code")) / 100
    return panel.withColumn("is_limit", F.coalesce(F.col(ret) >= limit - tol, F.lit(False))).withColumn("is_big", F.coalesce(F.col(ret) >= big, F.lit(False)))


def streak(panel: DataFrame, flag: str, name: str = "streak") -> DataFrame:
    """Consecutive rows with the flag up to this one: distance to the last row without it."""
    last_off = F.max(F.when(~F.col(flag), F.col("date_idx"))).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("date_idx").over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn(name, F.when(F.col(flag), F.col("date_idx") - F.coalesce(last_off, first - 1)).otherwise(0).cast("int"))


def with_rsi(panel: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss) over n row differences, all present."""
    diff = f"_{name}_diff"
    out = panel.withColumn(diff, F.col(value) - F.lag(value).over(by_code()))
    gain, loss = F.greatest(F.col(diff), F.lit(0.0)), F.greatest(-F.col(diff), F.lit(0.0))
    present = F.count(F.col(diff)).over(trailing(n)) >= n
    rs = F.avg(F.when(F.col(diff).isNotNull(), gain)).over(trailing(n)) / (F.avg(F.when(F.col(diff).isNotNull(), loss)).over(trailing(n)) + 1e-12)
    return out.withColumn(name, F.when(present, 100 - 100 / (1 + rs))).drop(diff)


def average_rank(value: str | Column, within: list[str], pct: bool = True) -> Column:
    """Average rank of a value among the non-null values of its group, as a share of their number."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*within)
    rank = F.rank().over(w.orderBy(v.asc_nulls_last())) + (F.count(v).over(Window.partitionBy(*within, v)) - 1) / 2
    return F.when(v.isNotNull(), rank / F.count(v).over(w) if pct else rank)


def xs_norm(panel: DataFrame, value: str, method: str = "rank", name: str = "normed") -> DataFrame:
    """Cross-sectional rank - 0.5, or z-score (no spread: null)."""
    if method == "rank":
        return panel.withColumn(name, average_rank(value, ["date_idx"]) - 0.5)
    if method != "zscore":
        raise ValueError(f"unknown method {method}")
    sd = F.stddev_samp(value).over(by_date())
    return panel.withColumn(name, (F.col(value) - F.avg(value).over(by_date())) / F.when(sd != 0, sd))


def forward_return(panel: DataFrame, value: str, n: int, name: str, tradable: str | None = None) -> DataFrame:
    """Return from this row to n rows on, without padding; null at the tail and where not tradable."""
    ratio = F.lead(value, n).over(by_code()) / F.col(value) - 1
    return panel.withColumn(name, F.when(F.col(tradable), ratio) if tradable else ratio)


def features(panel: DataFrame) -> DataFrame:
    """The panel with returns, averages, volatility, turnover ratio, RSI, limit flags and streak."""
    out = panel.withColumn("filled", padded("close"))
    for n in (1, 3, 5, 10, 20):
        out = out.withColumn(f"ret{n}", F.col("filled") / F.lag("filled", n).over(by_code()) - 1)
    for n in (5, 10, 20, 60):
        out = out.withColumn(f"ma{n}", rolling_mean("close", n))
    out = out.withColumn("vol20", rolling_std("ret1", 20))
    v5, v20 = rolling_mean("volume", 5), rolling_mean("volume", 20)
    out = out.withColumn("turn", v5 / F.when(v20 != 0, v20))
    out = with_rsi(with_rsi(out, "close", 6, "rsi6"), "close", 14, "rsi14")
    return streak(limit_flags(out), "is_limit").drop("filled")
