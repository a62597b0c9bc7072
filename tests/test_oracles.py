"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from barloom.plans import catalog, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


def order(row):
    return tuple((x is not None, f"{x:.5g}" if isinstance(x, float) else str(x)) for x in row)


#: A third of the queries, or all of them with ALL_QUERIES=1 (seven minutes).
NAMES = sorted(catalog.ORACLE_SQL)[:: 1 if os.environ.get("ALL_QUERIES") else 3]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    relation = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry_and_names(spark):
    assert entry_module.entry(spark).columns == ["combo", "hits", "mean_1d", "mean_3d", "mean_5d"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


#: Queries of the panel that differed from their SQL where suppliers share a code (F1 to F14).
SHARED = ("adj_close", "amount_caliber", "blend_anchor", "breadth", "breadth_gate_ma", "bt_core_satellite", "bt_daily_turnover", "bt_gated", "bt_market_gate", "bt_rebalance", "bt_sector_rotation", "build_label", "candle_patterns", "candle_patterns_basic")


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The smallest tables twice, suppliers moved by 500 and by 5,000: numbers 100 and 1000 have one code."""
    folder = tmp_path_factory.mktemp("shared")
    moved = {"lineitem": "l_orderkey + i * 1000000 as l_orderkey, l_suppkey + 500 + i * 4500 as l_suppkey", "supplier": "s_suppkey + 500 + i * 4500 as s_suppkey", "orders": "o_orderkey + i * 1000000 as o_orderkey"}
    connection = duckdb.connect()
    for t in (*moved, "nation", "region"):
        rows = f"select * exclude (i) replace ({moved[t]}) from '{SF}/{t}.parquet', (select unnest([0, 1]) as i)" if t in moved else f"select * from '{SF}/{t}.parquet'"
        connection.sql(f"copy ({rows}) to '{folder}/{t}.parquet' (format parquet)")
        connection.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return connection, str(folder)


@pytest.mark.parametrize("name", SHARED)
def test_suppliers_that_share_a_code_share_its_bars(spark, shared, name):
    connection, folder = shared
    df = catalog.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    relation = connection.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_panel_has_one_bar_for_each_code_and_week(spark, shared):
    from barloom.sources import panel

    assert panel.weekly_bars(spark, shared[1]).groupBy("code", "date").count().where("count > 1").isEmpty()


#: What the SQL leaves open where instruments share a code, closed as the operators close it.
HEAT = f"case when count(*) over {sql.t(10)} >= 10 then sum(is_limit::int + is_big::int) over {sql.t(10)} end as hh"
CLOSED = {
    "sig_sectorpulse": ((HEAT, HEAT.replace("order by date_idx", "order by date_idx, sector")),),
    "four_dim_score": (("amount desc nulls last, code)", "amount desc nulls last, code, name, industry)"), ("(partition by date_idx order by code)", "(partition by date_idx order by code, name, industry)")),
    "core_roles": (("amount desc nulls last, code)", "amount desc nulls last, code, name, industry)"), ("(partition by date_idx order by code)", "(partition by date_idx order by code, name, industry)")),
}


@pytest.mark.parametrize("name", CLOSED)
def test_instruments_that_share_a_code_keep_their_own_rows(spark, shared, name):
    connection, folder = shared
    text = catalog.ORACLE_SQL[name]
    for open_order, order_by in CLOSED[name]:
        assert open_order in text
        text = text.replace(open_order, order_by)
    df = catalog.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    relation = connection.sql(text)
    at = [relation.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
