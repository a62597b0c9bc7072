"""Common table expressions of the SQL that checks the queries."""

#: Weekly bars, dense panel, features: the same definitions as the operators.
CODE = "(['600','000','300','688','830'])[({0} % 5 + 1)::int] || lpad((({0} // 5))::varchar, 3, '0')"
BARS = f"""
bars as (
  select date_trunc('week', l_shipdate)::date as date, {CODE.format('l_suppkey')} as code,
    first(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as open,
    max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    last(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as close,
    sum(l_quantity) as volume, sum(l_extendedprice::decimal(18,2))::double as amount
  from lineitem group by all),
inst as (
  select {CODE.format('s_suppkey')} as code, case when s_acctbal < 0 then '*ST ' || s_name else s_name end as name, n_name as industry, r_name as sector
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
cal as (select date, row_number() over (order by date) - 1 as date_idx from (select distinct date from bars)),
dense as (
  select g.code, cal.date_idx, cal.date, b.open, b.high, b.low, b.close, b.volume, b.amount
  from (select code, min(date) as first from bars group by code) g join cal on cal.date >= g.first left join bars b on b.code = g.code and b.date = cal.date)"""


def t(n: int) -> str:
    return f"(partition by code order by date_idx rows between {n - 1} preceding and current row)"


W = "(partition by code order by date_idx)"
FEATURES = BARS + f""",
padded as (select *, last_value(close ignore nulls) over (partition by code order by date_idx rows between unbounded preceding and current row) as filled,
    close - lag(close) over {W} as diff from dense),
rets as (select *, {', '.join(f'filled / lag(filled, {n}) over {W} - 1 as ret{n}' for n in (1, 3, 5, 10, 20))} from padded),
feat0 as (select *,
    {', '.join(f'case when count(close) over {t(n)} >= {n} then avg(close) over {t(n)} end as ma{n}' for n in (5, 10, 20, 60))},
    case when count(ret1) over {t(20)} >= 20 then stddev_samp(ret1) over {t(20)} end as vol20,
    case when count(volume) over {t(5)} >= 5 then avg(volume) over {t(5)} end / nullif(case when count(volume) over {t(20)} >= 20 then avg(volume) over {t(20)} end, 0) as turn,
    {', '.join(f"case when count(diff) over {t(n)} >= {n} then 100 - 100 / (1 + avg(case when diff is not null then greatest(diff, 0.0) end) over {t(n)} / (avg(case when diff is not null then greatest(-diff, 0.0) end) over {t(n)} + 1e-12)) end as rsi{n}" for n in (6, 14))},
    coalesce(ret1 >= (case when code[1] in ('8', '4') then 29.8 when code[1:2] in ('30', '68') then 19.8 else 9.8 end) / 100 - 0.002, false) as is_limit,
    coalesce(ret1 >= 0.05, false) as is_big from rets),
feat as (select * exclude (filled, diff, isl), isl as streak from (select *,
    case when is_limit then date_idx - coalesce(max(case when not is_limit then date_idx end) over (partition by code order by date_idx rows between unbounded preceding and current row), min(date_idx) over (partition by code order by date_idx rows between unbounded preceding and current row) - 1) else 0 end::int as isl from feat0))"""


def with_(ctes: str, body: str) -> str:
    return f"with {ctes}\n{body}"
