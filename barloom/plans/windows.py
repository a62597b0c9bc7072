"""Queries of the rolling and cross-sectional features, and of the breadth of the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import windows as w
from ..sources import panel, store
from . import sql


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel, stored once for each state of the line items: bucketed by code,
    so features need no exchange."""
    return store.stored(spark, "panel", [f"{sf_dir}/lineitem.parquet"], lambda: panel.densify(panel.weekly_bars(spark, sf_dir)))


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, date_idx) of the stored panel."""
    return dense(spark, sf_dir).select("date", "date_idx").distinct()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.features(dense(spark, sf_dir))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> list:
    return [F.round(F.col(n), digits).alias(n) for n in names]


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def feature_query(key: str, *names: str, plain: tuple = ()):
    def run(spark, sf_dir):
        df = features(spark, sf_dir)
        return df.select("code", "date", *rounded(df, *names), *plain)

    QUERIES[key] = run
    columns = [*(f"round({n}, 6) as {n}" for n in names), *plain]
    ORACLE_SQL[key] = sql.with_(sql.FEATURES, f"select code, date, {', '.join(columns)} from feat")


feature_query("pct_change", "ret1", "ret5", "ret10", "ret20")
feature_query("rolling_ma", "ma5", "ma10", "ma20", "ma60")
feature_query("rolling_vol", "vol20")
feature_query("turn_ratio", "turn")
feature_query("rsi", "rsi6", "rsi14")
feature_query("limit_streak", plain=("is_limit", "streak"))


def breadth(spark, sf_dir):
    df = w.pct_change(dense(spark, sf_dir), "close", 1, "ret1")
    up, down, there = F.count_if(F.col("ret1") > 0), F.count_if(F.col("ret1") < 0), F.count("ret1")
    return df.groupBy("date").agg(up.alias("up"), down.alias("down"), F.count_if(F.col("ret1") == 0).alias("flat"), there.alias("total"), F.round(F.when(there > 0, up * 100.0 / there), 2).alias("red_pct"))


QUERIES["breadth"] = breadth
ORACLE_SQL["breadth"] = sql.with_(sql.FEATURES, "select date, count(*) filter (ret1 > 0) as up, count(*) filter (ret1 < 0) as down, count(*) filter (ret1 = 0) as flat, count(ret1) as total, round(count(*) filter (ret1 > 0) * 100.0::double / nullif(count(ret1), 0), 2) as red_pct from feat group by date")
