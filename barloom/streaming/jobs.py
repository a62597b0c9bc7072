"""Incremental twins of batch jobs on Structured Streaming.

Results and state are files: every batch writes a version v<epoch> of its own from
the last complete version below it, so a job that starts anew on the same folder
goes on where the last one stopped, and a replayed batch changes nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType


def last_version(spark: SparkSession, path: str, below: int | None = None) -> str | None:
    """The newest complete version under path (of an epoch less than `below`)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return None
    names = [x.getPath().getName() for x in files.listStatus(folder)]
    epochs = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
    done = (e for e in epochs if (below is None or e < below) and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{e}/_SUCCESS")))
    return next((f"{path}/v{e}" for e in done), None)


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream over the files of a folder (or one file)."""
    head, _, tail = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", tail).parquet(head)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result table, kept as
    files under path: appended rows, or the last complete result."""
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/rows")
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/v{epoch}"))
    writer.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()
    found = f"{path}/rows" if mode == "append" else last_version(spark, path)
    return spark.read.schema(stream.schema).parquet(found) if found else spark.createDataFrame([], stream.schema)


DAY = 86_400


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []


def daily_bars(events: DataFrame, path: str, late: int = DAY) -> None:
    """Run a stream (ts, event_id, code, value) into bars per day and code, in append
    mode: a day's bar is written once, when the newest time seen is `late` seconds past
    its end. Only open days are kept as state; rows of a closed day go to a second
    table, labelled with the watermark they missed.

    Under path: bars/ and late/ by epoch, and versions of the open days in open/. A
    replayed batch writes the same again; a restart goes on from the last version.
    Rows without a time are late with a null watermark."""
    spark = events.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        held = last_version(spark, f"{path}/open", epoch)
        before = spark.read.parquet(held) if held else None
        seen = spark.read.parquet(held.replace("/open/", "/seen/")).first()[0] if held else None
        mark = None if seen is None else seen - late
        day = F.date_trunc("day", "ts")
        closed = F.lit(False) if mark is None else F.unix_timestamp(day) + DAY <= mark
        is_late = F.coalesce(closed, F.lit(True))
        batch.where(is_late).withColumn("watermark", F.when(F.col("ts").isNotNull(), F.lit(mark).cast("long").cast("timestamp"))).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        one = F.struct("ts", "event_id", F.col("value").cast("double").alias("value"))
        rows = batch.where(~is_late).select(day.alias("start"), F.col("code").cast("long").alias("code"), one.alias("x"))
        paid = F.sum(F.col("x.value").cast("decimal(18,2)")).cast("decimal(38,2)")
        fresh = rows.groupBy("start", "code").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.max("x.value").alias("high"), F.min("x.value").alias("low"), F.count("*").alias("n"), paid.alias("volume"))
        both = fresh if before is None else fresh.unionByName(before)
        total = [F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("volume").cast("decimal(38,2)").alias("volume")]
        merged = both.groupBy("start", "code").agg(*total)
        newest = batch.agg(F.max(F.unix_timestamp("ts"))).first()[0]
        newest = max((x for x in (seen, newest) if x is not None), default=None)
        done = F.lit(False) if newest is None else F.unix_timestamp("start") + DAY <= newest - late
        merged.where(done).write.mode("overwrite").parquet(f"{path}/bars/epoch={epoch}")
        spark.createDataFrame([(newest,)], "newest long").write.mode("overwrite").parquet(f"{path}/seen/v{epoch}")
        merged.where(~done).select("start", "code", "first", "last", "high", "low", "n", "volume").write.mode("overwrite").parquet(f"{path}/open/v{epoch}")
        for name in _children(spark, f"{path}/open"):  # a replay needs the version before this one
            if name[:1] == "v" and int(name[1:]) < epoch - 1:
                _delete(spark, f"{path}/open/{name}")

    events.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()


def bars_of(spark: SparkSession, path: str, still_open: bool = False) -> DataFrame:
    """(start, code, open, high, low, close, n, volume) of the closed days, and of
    those still open if asked for."""
    rows = spark.read.parquet(f"{path}/bars").drop("epoch")
    held = last_version(spark, f"{path}/open")
    rows = rows.unionByName(spark.read.parquet(held)) if still_open and held else rows
    return rows.select("start", "code", F.col("first.value").alias("open"), "high", "low", F.col("last.value").alias("close"), "n", F.col("volume").cast("double").alias("volume"))


def dedupe(items: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    """The first item per key within the watermark."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


BUCKETS = 64


def upsert_latest(stream: DataFrame, keys: list[str], order: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Each batch is merged into the table at path: the latest row per key wins (ties:
    the greatest row). Returns the newest version.

    Keys are dealt to `buckets` by hash. A batch rewrites the buckets that its keys lie
    in and no others; the version's list (bucket, epoch that holds it) has a row for
    each bucket. Data of epochs that neither the newest list nor the one before names
    are deleted, so that a batch may be replayed. The number of buckets stays as it
    was when the table began."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        held = last_version(spark, f"{path}/list", epoch)
        where = {r.bucket: r.epoch for r in spark.read.parquet(held).collect()} if held else {}  # `buckets` rows at most
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        old = [f"{path}/data/epoch={where[b]}/bucket={b}" for b in touched if b in where]
        if old:
            there = spark.read.option("basePath", f"{path}/data").parquet(*old).drop("epoch")
            rows = rows.unionByName(there.withColumn("bucket", F.col("bucket").cast("int")))
        best = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*batch.columns), F.struct(order, *[c for c in batch.columns if c != order])).alias("_r")).select("bucket", "_r.*")
        best.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        where |= dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(where.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/list/v{epoch}")
        before = {r.epoch for r in spark.read.parquet(held).collect()} if held else set()
        for name in _children(spark, f"{path}/data"):
            if name.startswith("epoch=") and int(name[6:]) not in before | set(where.values()):
                _delete(spark, f"{path}/data/{name}")

    stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", f"{path}/_checkpoint").start().awaitTermination()
    held = last_version(spark, f"{path}/list")
    parts = [f"{path}/data/epoch={r.epoch}/bucket={r.bucket}" for r in spark.read.parquet(held).collect()] if held else []
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*parts)


def streaks(events: DataFrame, idle: str | None = None) -> DataFrame:
    """(code, event_id, ts, streak) of a stream (code, event_id, ts, flag): the run of a
    code lives in the stream's keyed state, so a batch costs what its own codes cost.

    Batches arrive in order of time; a batch's rows of one code are sorted by (ts,
    event_id) in memory, bounded by what a batch may hold. With `idle` (an interval)
    a code without rows for that long, by the watermark, is forgotten and counts anew."""

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        run, out = state.get[0] if state.exists else 0, []
        for flag in rows["flag"].fillna(False).astype(bool):
            run = run + 1 if flag else 0
            out.append(run)
        state.update((run,))
        if idle is not None:
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield rows.assign(streak=out)[["code", "event_id", "ts", "streak"]]

    kind = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    rows = events if idle is None else events.withWatermark("ts", "0 seconds")
    return rows.groupBy("code").applyInPandasWithState(step, "code long, event_id long, ts timestamp, streak int", "run int", "append", kind)
