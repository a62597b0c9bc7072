"""Streaming jobs drained over the events table, checked against their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.columns import scratch
from ..streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def events(spark, sf_dir) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = jobs.source(spark, f"{sf_dir}/events.parquet", schema)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("code"), "value", "event_type")


def st_bars(spark, sf_dir) -> DataFrame:
    """Closed days, and those still open when the source is drained."""
    path = scratch(spark, "bars")
    jobs.daily_bars(events(spark, sf_dir), path)
    return jobs.bars_of(spark, path, still_open=True).withColumn("start", F.col("start").cast("date"))


def st_news_dedupe(spark, sf_dir) -> DataFrame:
    out = jobs.drain(jobs.dedupe(events(spark, sf_dir).select("event_type", "code", "ts"), ["event_type", "code"]), scratch(spark, "dedupe"))
    return out.select("event_type", "code")


QUERIES["st_bars"] = st_bars
ORACLE_SQL["st_bars"] = "select ts::date as start, user_id as code, arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, (ts, event_id)) as close, count(*) as n, sum(value::decimal(18,2))::double as volume from events group by all"
QUERIES["st_news_dedupe"] = st_news_dedupe
ORACLE_SQL["st_news_dedupe"] = "select distinct event_type, user_id as code from events"


def st_flow_upsert(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "upsert")
    return jobs.upsert_latest(events(spark, sf_dir).select("code", "event_type", "event_id", "value"), ["code", "event_type"], "event_id", path)


def st_resume(spark, sf_dir) -> DataFrame:
    """The stream is drained twice with one checkpoint: the second run finds nothing new."""
    path = scratch(spark, "resume")
    out = f"{path}/out"
    for _ in range(2):
        rows = events(spark, sf_dir).select("event_id", "code")
        rows.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def st_streak(spark, sf_dir) -> DataFrame:
    """Running count of consecutive large values per code: keyed state in the stream."""
    rows = events(spark, sf_dir).select("code", "event_id", "ts", (F.col("value") > 5).alias("flag"))
    return jobs.drain(jobs.streaks(rows), scratch(spark, "streak")).select("code", "event_id", "streak")


QUERIES |= {"st_flow_upsert": st_flow_upsert, "st_resume": st_resume, "st_streak": st_streak}
ORACLE_SQL["st_flow_upsert"] = "select user_id as code, event_type, max(event_id) as event_id, max_by(value, event_id) as value from events group by all"
ORACLE_SQL["st_resume"] = "select user_id as code, count(*) as n, count(distinct event_id) as ids from events group by 1"
ORACLE_SQL["st_streak"] = """select code, event_id, case when flag then k - coalesce(max(case when not flag then k end) over (partition by code order by k rows unbounded preceding), 0) else 0 end::int as streak
from (select user_id as code, event_id, value > 5 as flag, row_number() over (partition by user_id order by ts, event_id) as k from events)"""
