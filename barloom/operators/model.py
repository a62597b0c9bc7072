"""A learned score: boosted trees with a time split, and the replay of its best names."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from .portfolio import next_return, top_k


def fit(rows: DataFrame, factors: list[str], label: str, train_end: int, valid_end: int, horizon: int, path: str, rounds: int = 40, depth: int = 4, tolerance: float = 0.001, seed: int = 7) -> GBTRegressionModel:
    """Boosted trees on rows(date_idx, factors, label), saved at path and read back.

    Rows before train_end teach; rows from there to valid_end only tell when to stop,
    once their error no longer falls by `tolerance`. A row whose label reaches into
    the next segment (date_idx + horizon) belongs to neither. Scores are in standard
    deviations of the label. Rows with a null factor
    or label are left out; without rows to learn from Spark ML raises."""
    inside = rows.where((F.col("date_idx") + horizon < train_end) | ((F.col("date_idx") >= train_end) & (F.col("date_idx") + horizon < valid_end)))
    known = inside.dropna(subset=[*factors, label]).withColumn("held_out", F.col("date_idx") >= train_end)
    spread = known.where(~F.col("held_out")).agg(F.stddev_samp(label)).first()[0] or 1.0  # the stop rule compares errors of the order of 1
    vectors = VectorAssembler(inputCols=factors, outputCol="factors").transform(known.select("held_out", (F.col(label) / spread).alias("label"), *factors))
    trees = GBTRegressor(featuresCol="factors", labelCol="label", validationIndicatorCol="held_out", validationTol=tolerance, maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.85, minInstancesPerNode=20, seed=seed)
    trees.fit(vectors.select("factors", "label", "held_out")).write().overwrite().save(path)
    return GBTRegressionModel.load(path)


def score(rows: DataFrame, factors: list[str], model: GBTRegressionModel) -> DataFrame:
    """rows with a column score; null where a factor is."""
    whole = F.lit(True)
    for c in factors:
        whole = whole & F.col(c).isNotNull()
    filled = VectorAssembler(inputCols=[f"_{c}" for c in factors], outputCol="factors").transform(rows.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in factors}))
    out = model.transform(filled).withColumn("score", F.when(whole, F.col("prediction")))
    return out.drop("factors", "prediction", *[f"_{c}" for c in factors])


def nav(scores: DataFrame, panel: DataFrame, days: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """(date_idx, date, ret, nav, bench_ret, bench_nav, n_hold) of [start, end - 1): a day's
    k best names are held to the next row; the benchmark holds all names alike. A day
    without scores earns nothing."""
    inside = (F.col("date_idx") >= start) & (F.col("date_idx") < end - 1)
    prices = next_return(panel).where(inside).select("date_idx", "code", "next_ret")
    picks = top_k(scores.where(inside), k).select("date_idx", "code", F.lit(1).alias("held"))
    daily = prices.join(picks, ["date_idx", "code"], "left").groupBy("date_idx").agg(
        F.avg("next_ret").alias("bench"), F.avg(F.when(F.col("held") == 1, F.col("next_ret"))).alias("own"), F.count("held").alias("n_hold")
    )
    rows = days.where(inside).join(daily, "date_idx", "left").select("date_idx", "date", F.coalesce("own", F.lit(0.0)).alias("ret"), F.coalesce("bench", F.lit(0.0)).alias("bench_ret"), F.coalesce("n_hold", F.lit(0)).alias("n_hold"))
    so_far = Window.orderBy("date_idx").rowsBetween(Window.unboundedPreceding, 0)  # one row per trading date
    grown = lambda c: F.exp(F.sum(F.log1p(c)).over(so_far))
    return rows.select("date_idx", "date", "ret", grown("ret").alias("nav"), "bench_ret", grown("bench_ret").alias("bench_nav"), "n_hold")
