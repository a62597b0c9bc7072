"""Sources and sinks: round trips through files, and rows that do not fit."""

import datetime
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from barloom.sources import columns, panel
from barloom.streaming import jobs


@pytest.fixture
def bars(spark):
    day = datetime.date(2026, 1, 5)
    rows = [(day, "600000", 1.0, 2.0, 0.5, 1.5, 10.0, 15.0), (day + datetime.timedelta(days=2), "600000", 2.0, 3.0, 1.5, 2.5, 20.0, 50.0), (day + datetime.timedelta(days=1), "300001", 5.0, 6.0, 4.5, None, 30.0, 165.0), (day + datetime.timedelta(days=2), "300001", 5.0, 6.0, 4.5, 5.5, 30.0, 165.0)]
    return spark.createDataFrame(rows, "date date, code string, open double, high double, low double, close double, volume double, amount double")


def test_panel_round_trip(spark, bars, tmp_path):
    panel.write_panel(bars, f"{tmp_path}/panel", files=2)
    back = spark.read.parquet(f"{tmp_path}/panel")
    assert back.count() == 3 and back.where("close is null").count() == 0


def test_dense_panel_starts_at_the_first_bar(bars):
    got = [(r.code, r.date_idx, r.close) for r in panel.densify(bars).orderBy("code", "date_idx").collect()]
    assert got == [("300001", 1, None), ("300001", 2, 5.5), ("600000", 0, 1.5), ("600000", 1, None), ("600000", 2, 2.5)]


def test_wide_and_long(bars):
    wide = panel.long_to_wide(bars, ["600000", "300001"])
    assert {(r.code, r.close) for r in panel.wide_to_long(wide).collect()} == {("600000", 1.5), ("600000", 2.5), ("300001", 5.5)}
    assert panel.long_to_wide(bars, ["600000"], last_days=1).count() == 1


def test_column_files(spark, tmp_path):
    for code, start, values in (("sh600000", 3, [1.0, float("nan"), 2.5]), ("sz000001", 0, []), ("bj830000", 0, None)):
        folder = tmp_path / code
        folder.mkdir()
        data = b"" if values is None else struct.pack(f"<{len(values) + 1}f", start, *values)
        (folder / "close.day.bin").write_bytes(data)
    got = [(r.code, r.date_idx, r.value) for r in columns.read_column_files(spark, f"{tmp_path}/*/close.day.bin").orderBy("date_idx").collect()]
    assert got == [("sh600000", 3, 1.0), ("sh600000", 5, 2.5)]


def test_instruments_with_one_or_three_fields(spark, tmp_path):
    (tmp_path / "all.txt").write_text("SH600000\t2020-01-02\t2026-01-05\nSZ000001\n")
    got = {r.code: (r.start, r.stop) for r in columns.read_instruments(spark, f"{tmp_path}/all.txt").collect()}
    assert got == {"SH600000": (datetime.date(2020, 1, 2), datetime.date(2026, 1, 5)), "SZ000001": (None, None)}


def test_typed_records(spark):
    raw = spark.createDataFrame([('{"code": "600000", "eps": "1.5", "day": "2026-01-05"}',), ('{"eps": "-", "noise": 1}',), ("not json",), (None,)], "json string")
    got = columns.typed_records(raw, {"code": "string", "eps": "double", "day": "date"}).collect()
    assert (got[0].code, got[0].eps, str(got[0].day)) == ("600000", 1.5, "2026-01-05")
    assert all(r.eps is None and r.day is None for r in got[1:])


def test_streak_state_crosses_batches(spark, tmp_path):
    """Three files, one per batch: the run goes on where the last batch ended."""
    start = datetime.datetime(2026, 1, 5)
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    for k in range(3):
        rows = [(1, i, start + datetime.timedelta(minutes=i), bool(flags[i])) for i in range(3 * k, 3 * k + 3)]
        spark.createDataFrame(rows, "code long, event_id long, ts timestamp, flag boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("code long, event_id long, ts timestamp, flag boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.event_id: r.streak for r in jobs.drain(jobs.streaks(stream), f"{tmp_path}/state").collect()}
    assert [got[i] for i in range(9)] == [1, 2, 0, 1, 2, 3, 4, 0, 1]


def test_upsert_keeps_the_latest_over_batches(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, k, float(k)), (k + 2, 0, 1.0)], "code long, seq long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("code long, seq long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.code: r.value for r in jobs.upsert_latest(stream, ["code"], "seq", f"{tmp_path}/out").collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_state_survives_a_restart(spark, tmp_path):
    """Each file is drained by a stream object of its own: state comes from disk."""
    start = datetime.datetime(2026, 1, 5)
    flags, got, latest = [1, 1, 0, 1, 1, 1], {}, {}
    for k in range(3):
        rows = [(1, i, start + datetime.timedelta(minutes=i), bool(flags[i])) for i in range(2 * k, 2 * k + 2)]
        spark.createDataFrame(rows, "code long, event_id long, ts timestamp, flag boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        spark.createDataFrame([(1, k, float(k)), (k + 2, 0, 1.0)], "code long, seq long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        runs = spark.readStream.schema("code long, event_id long, ts timestamp, flag boolean").parquet(f"{tmp_path}/a")
        got = {r.event_id: r.streak for r in jobs.drain(jobs.streaks(runs), f"{tmp_path}/runs").collect()}
        rows = spark.readStream.schema("code long, seq long, value double").parquet(f"{tmp_path}/b")
        latest = {r.code: r.value for r in jobs.upsert_latest(rows, ["code"], "seq", f"{tmp_path}/latest").collect()}
    assert [got[i] for i in range(6)] == [1, 2, 0, 1, 2, 3]
    assert latest == {1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_drained_results_are_files(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "code long, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("code long, value double").parquet(f"{tmp_path}/in")
    assert jobs.drain(stream, f"{tmp_path}/rows").count() == 3
    assert {(r.code, r["count"]) for r in jobs.drain(stream.groupBy("code").count(), f"{tmp_path}/sums", "complete").collect()} == {(1, 2), (2, 1)}


def test_stored_panel_is_read_without_an_exchange(spark, tmp_path):
    from barloom.operators import windows
    from barloom.sources import store

    bars = panel.weekly_bars(spark, "/root/testdata/sf0.001")
    bars.write.parquet(f"{tmp_path}/in")
    built = []

    def build():
        built.append(1)
        return panel.densify(spark.read.parquet(f"{tmp_path}/in"))

    get = lambda: store.stored(spark, "trial", [f"{tmp_path}/in"], build)
    first, again = get(), get()
    assert len(built) == 1 and sorted(map(str, first.collect())) == sorted(map(str, panel.densify(bars).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = windows.features(again)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Window" in plan and "Exchange hashpartitioning(code" not in plan
    bars.limit(5).write.mode("append").parquet(f"{tmp_path}/in")
    get()
    assert len(built) == 2  # the input has changed


def put(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def test_bars_close_once_late_rows_are_labelled_and_state_falls(spark, tmp_path):
    kind = "event_id long, ts timestamp, code long, value double"
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    batches = [
        [(1, at(1, 9), 7, 5.0), (2, at(1, 10), 7, 9.0), (3, at(1, 9), 8, 1.5), (4, at(2, 9), 7, 4.0)],
        [(5, at(1, 8), 7, 3.0), (6, at(4, 9), 7, 6.0)],  # closes day 1 (and 2 at 09:00 of day 4)
        [(7, at(1, 11), 7, 99.0), (8, at(4, 8), 8, 2.0), (9, None, 7, 1.0)],  # too late; in time; without a time
    ]
    path, sizes = f"{tmp_path}/job", []
    for rows in batches:
        put(spark, f"{tmp_path}/in", rows, kind)
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        jobs.daily_bars(stream, path)  # a new start each time
        sizes.append(spark.read.parquet(jobs.last_version(spark, f"{path}/open")).count())
    closed = sorted((r.start.day, r.code, r.open, r.high, r.low, r.close, r.n, r.volume) for r in jobs.bars_of(spark, path).collect())
    assert closed == [(1, 7, 3.0, 9.0, 3.0, 9.0, 3, 17.0), (1, 8, 1.5, 1.5, 1.5, 1.5, 1, 1.5), (2, 7, 4.0, 4.0, 4.0, 4.0, 1, 4.0)]
    assert sizes == [3, 1, 2]
    late = {r.event_id: r.watermark for r in spark.read.parquet(f"{path}/late").collect()}
    assert set(late) == {7, 9} and late[9] is None and late[7] == at(3, 9)
    assert jobs.bars_of(spark, path, still_open=True).count() == 5


def test_an_upsert_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    kind, path = "code long, seq long, value double", f"{tmp_path}/table"
    held = lambda: {r.bucket: r.epoch for r in spark.read.parquet(jobs.last_version(spark, f"{path}/list")).collect()}

    def go(rows):
        put(spark, f"{tmp_path}/in", rows, kind)
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        return {r.code: r.value for r in jobs.upsert_latest(stream, ["code"], "seq", path, buckets=100).collect()}

    assert go([(c, 1, float(c)) for c in range(1000)]) == {c: float(c) for c in range(1000)}
    first = held()
    want = {c: float(c) for c in range(1000)} | {5: -5.0, 2000: 1.0}
    assert go([(5, 2, -5.0), (6, 0, -6.0), (2000, 1, 1.0)]) == want
    changed = [b for b, e in held().items() if first.get(b) != e]
    assert len(first) == 100 and 1 <= len(changed) <= 3
    assert len(os.listdir(f"{path}/data/epoch=1")) <= 5 + len(changed)
    assert go([(5, 3, 5.5)]) == want | {5: 5.5}


def test_an_idle_code_counts_anew(spark, tmp_path):
    kind = "event_id long, ts timestamp, code long, flag boolean"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for rows in ([(1, day(0), 1, True), (2, day(1), 2, True)], [(3, day(20), 2, True)], [(4, day(21), 2, None)], [(5, day(22), 1, True), (6, day(23), 2, True)]):
        put(spark, f"{tmp_path}/in", rows, kind)
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        out = jobs.drain(jobs.streaks(stream, idle="10 days"), f"{tmp_path}/idle")
        kept = jobs.drain(jobs.streaks(stream), f"{tmp_path}/kept")
    assert {r.event_id: r.streak for r in out.collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 1, 6: 1}
    assert {r.event_id: r.streak for r in kept.collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 2, 6: 1}


ITEMS = "l_shipdate timestamp_ntz, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_suppkey long"


@pytest.fixture
def items(spark, tmp_path):
    """Line items of two weeks and three suppliers, many tied in their first columns: times
    of day, thirds, negative and very large keys among whole days and hundredths."""
    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        at = datetime.datetime(2026, 1, 5) + datetime.timedelta(days=rng.randrange(14))
        if rng.random() < 0.2:
            at += datetime.timedelta(microseconds=rng.randrange(86_400_000_000))
        order, part = rng.choice((-5, 1, 1, 2, 2**40 - 1, 2**40)), rng.choice((-1, 7, 8, 2**18, 2**32 - 1, 2**32))
        price = rng.choice((0.01, 901.29, 1342177.27, 1342177.28, 10 / 3, -0.5))
        rows.append((at, order, rng.choice((0, 1, 63, 64)), part, rng.choice((1.0, 0.01, 2621.43, 2621.44, 1 / 3)), price, rng.randrange(3)))
    spark.createDataFrame(rows, ITEMS).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path), rows


def test_bars_open_and_close_by_the_order_of_all_columns(spark, items):
    folder, rows = items
    groups = {}
    for r in rows:
        groups.setdefault(((r[0] - datetime.timedelta(days=r[0].weekday())).date(), r[6]), []).append(r[:6])
    want = {k: (min(g)[5] / min(g)[4], max(x[5] / x[4] for x in g), min(x[5] / x[4] for x in g), max(g)[5] / max(g)[4]) for k, g in groups.items()}
    got = {(r.date, panel.PREFIXES.index(r.code[:3])): (r.open, r.high, r.low, r.close) for r in panel.weekly_bars(spark, folder).collect()}
    assert got == want


def test_packed_order_keeps_each_row_that_fits(spark, items):
    rows = panel.table(spark, items[0], "lineitem").withColumn("week", F.date_trunc("week", "l_shipdate").cast("date"))
    types = {c: rows.schema[c].dataType for c in panel.ORDER}
    both = rows.withColumn("p", panel.packed_order(F.col("week"), types["l_shipdate"])).withColumn("o", F.struct(*panel.ORDER)).withColumn("back", panel.unpacked_order("p", "week", types)).where("p is not null")
    got = both.select("week", "p", "o", "back").collect()
    assert 100 < len(got) < 2000 and all(r.o == r.back for r in got)
    assert [r.o for r in sorted(got, key=lambda r: (r.week, r.p))] == sorted(r.o for r in got)


def test_line_items_are_not_sorted_before_they_are_combined(spark, items):
    plan = panel.weekly_bars(spark, items[0])._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("Exchange")[-1]
    assert "HashAggregate" in scan and "Sort" not in scan
