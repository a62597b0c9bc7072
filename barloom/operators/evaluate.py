"""Factor evaluation: labels, information coefficients, Newey-West t, quantile layers.

Factors are long rows (factor, code, date_idx, date, value), so any number of
them shares the same two shuffles: by code for the panel, by (factor, date).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .windows import average_rank


def ic_series(rows: DataFrame, method: str = "rank", least: int = 20) -> DataFrame:
    """(factor, date_idx, date, ic) over rows(factor, code, date_idx, date, value,
    label): the day's correlation of value and label, of ranks taken before
    incomplete pairs are left out; null under `least` pairs."""
    x, y = F.col("value"), F.col("label")
    ranked = rows
    if method == "rank":
        ranked = rows.withColumn("_x", average_rank("value", ["factor", "date_idx"])).withColumn("_y", average_rank("label", ["factor", "date_idx"]))
        x, y = F.col("_x"), F.col("_y")
    both = x.isNotNull() & y.isNotNull()
    n = F.count_if(both)
    out = ranked.groupBy("factor", "date_idx", "date").agg(n.alias("n"), F.corr(F.when(both, x), F.when(both, y)).alias("ic"))
    return out.select("factor", "date_idx", "date", F.when((F.col("n") >= least) & ~F.isnan("ic"), F.col("ic")).alias("ic"))


def newey_west(series: DataFrame, value: str, by: str, lag: int | None = None, most: int = 12) -> DataFrame:
    """(by, n, mean, t_nw): t of the mean with Bartlett weights, over the non-null
    values in date order. Default lag: floor(4 (n / 100)^(2/9)), `most` at most;
    under 5 values, or without positive variance: null."""
    w = Window.partitionBy(by).orderBy("date_idx")
    rows = series.where(F.col(value).isNotNull())
    rows = rows.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    lags = range(1, (lag if lag is not None else most) + 1)
    for k in lags:
        rows = rows.withColumn(f"_g{k}", F.col("_d") * F.lag("_d", k).over(w))
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("_g0"), *[F.sum(f"_g{k}").alias(f"_g{k}") for k in lags])
    used = F.lit(lag) if lag is not None else F.least(F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2 / 9))), F.lit(most))
    used = F.greatest(F.least(used, F.col("n") - 1), F.lit(0))
    total = F.col("_g0") / F.col("n")
    for k in lags:
        total = total + F.when(used >= k, 2 * (1 - k / (used + 1.0)) * F.coalesce(f"_g{k}", F.lit(0.0)) / F.col("n")).otherwise(0.0)
    variance = total / F.col("n")
    return sums.select(by, "n", "mean", F.when((F.col("n") >= 5) & (variance > 0), F.col("mean") / F.sqrt(variance)).alias("t_nw"))


def ic_report(ics: DataFrame, horizon: int = 5) -> DataFrame:
    """(factor, n_days, ic_mean, ic_std, icir, t_nw, win_rate), one row per factor."""
    sd = F.stddev_samp("ic")
    base = ics.where("ic is not null").groupBy("factor").agg(F.count("*").alias("n_days"), F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    base = base.withColumn("icir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")))
    return base.join(newey_west(ics, "ic", "factor", horizon).select("factor", "t_nw"), "factor")


def layers(rows: DataFrame, n: int = 5, least: int = 20) -> DataFrame:
    """(factor, date_idx, date, layer, ret): mean of next_ret per quantile layer
    (1..n) of the value; days with fewer than `least` complete rows are left
    out. Layers follow linear quantile edges of the first-come rank (ties: code)."""
    whole = rows.where("value is not null and next_ret is not null")
    w = Window.partitionBy("factor", "date_idx")
    numbered = whole.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("value", "code"))).where(F.col("_n") >= least)
    layer = F.greatest(F.ceil((F.col("_r") - 1) * n / (F.col("_n") - 1.0)), F.lit(1))
    return numbered.withColumn("layer", layer.cast("int")).groupBy("factor", "date_idx", "date", "layer").agg(F.avg("next_ret").alias("ret"))


def layer_report(layered: DataFrame, n: int = 5) -> DataFrame:
    """(factor, mono, ls_ann): correlation of layer number and mean return, and the
    annualised mean of the top layer less the bottom layer."""
    means = layered.groupBy("factor", "layer").agg(F.avg("ret").alias("m"))
    mono = means.groupBy("factor").agg(F.corr(F.col("layer").cast("double"), "m").alias("mono"))
    day = layered.groupBy("factor", "date_idx").agg(F.max(F.when(F.col("layer") == n, F.col("ret"))).alias("hi"), F.max(F.when(F.col("layer") == 1, F.col("ret"))).alias("lo"))
    spread = day.groupBy("factor").agg((F.pow(1 + F.avg(F.col("hi") - F.col("lo")), 252) - 1).alias("ls_ann"))
    return mono.join(spread, "factor")
