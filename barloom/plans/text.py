"""Queries of scalar functions, text jobs and the disclosure scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import scalar as sc
from ..operators import text as tx
from ..sources import panel
from . import sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(key: str, run, body: str | None, ctes: str = "") -> None:
    QUERIES[key] = run
    if body:
        ORACLE_SQL[key] = sql.with_(ctes, body) if ctes else body


T = panel.table

# --- codes, numbers, dates -----------------------------------------------------
RAW = "case s_suppkey % 3 when 0 then 'sh6' || lpad(s_suppkey::varchar, 5, '0') when 1 then '0' || lpad(s_suppkey::varchar, 5, '0') || '.SZ' else '3' || lpad(s_suppkey::varchar, 5, '0') end"


def raw_codes(spark, sf_dir) -> DataFrame:
    key, text = F.col("s_suppkey"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    raw = F.when(key % 3 == 0, F.concat(F.lit("sh6"), text)).when(key % 3 == 1, F.concat(F.lit("0"), text, F.lit(".SZ"))).otherwise(F.concat(F.lit("3"), text))
    return T(spark, sf_dir, "supplier").select("s_suppkey", "s_name", raw.alias("raw"))


add("code_normalise", lambda s, d: raw_codes(s, d).select("s_suppkey", sc.code6(F.col("raw")).alias("code"), sc.prefixed(F.col("raw")).alias("full")), f"select s_suppkey, code, case when code[1] in ('6', '9') then 'SH' when code[1] in ('0', '3', '2') then 'SZ' when code[1] in ('8', '4') then 'BJ' end || code as full from (select s_suppkey, regexp_extract({RAW}, '[0-9]{{6}}') as code from supplier)")
add("name_resolve", lambda s, d: raw_codes(s, d).join(raw_codes(s, d).where("s_suppkey % 4 != 0").select(sc.code6(F.col("raw")).alias("c6"), F.col("s_name").alias("name")), sc.code6(F.col("raw")) == F.col("c6"), "left").select("s_suppkey", sc.pretty(F.col("name"), sc.code6(F.col("raw"))).alias("label")), f"select s_suppkey, case when s_suppkey % 4 != 0 then s_name || '(' || code || ')' else code end as label from (select *, regexp_extract({RAW}, '[0-9]{{6}}') as code from supplier)")
add("code_valid", lambda s, d: raw_codes(s, d).where(sc.code_valid(F.col("raw"))).select("s_suppkey", "raw"), f"select s_suppkey, raw from (select s_suppkey, {RAW} as raw from supplier) where regexp_matches(raw, '^[0-9]{{6}}$')")
add("code_majority_guard", lambda s, d: T(s, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share")).where("share >= 0.5").select("batch", "n"), "select o_custkey as batch, count(*) as n from orders group by 1 having avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) >= 0.5")
add("parse_num", lambda s, d: T(s, d, "orders").select("o_orderkey", sc.parse_num(F.when(F.col("o_orderkey") % 5 == 0, "--").when(F.col("o_orderkey") % 5 == 1, "").when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".50%"))).otherwise(F.col("o_custkey").cast("string"))).alias("value")), "select o_orderkey, case when o_orderkey % 5 in (0, 1) then null when o_orderkey % 5 = 2 then 1000.5 + o_orderkey % 1000 else o_custkey end::double as value from orders")
add("parse_date", lambda s, d: T(s, d, "events").select("event_id", sc.parse_date(F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "MM-dd HH:mm")), F.lit(2024)).alias("day")), "select event_id, case when event_id % 3 = 2 then make_date(2024, month(ts), day(ts)) else ts::date end as day from events")
add("epoch_to_local", lambda s, d: T(s, d, "events").select("event_id", sc.epoch_to_local(F.when(F.col("event_id") % 7 == 0, F.lit(0)).when(F.col("event_id") % 2 == 0, F.unix_seconds(F.col("ts").cast("timestamp"))).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))).alias("local")), "select event_id, case when event_id % 7 = 0 then '' else strftime(date_trunc('second', ts) + interval 8 hour, '%Y-%m-%d %H:%M:%S') end as local from events")
add("date_slices", lambda s, d: T(s, d, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b")).select("a", "b", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.greatest("a", "m").alias("start"), F.least("b", F.last_day("m")).alias("stop")), "select greatest(a, m) as start, least(b, last_day(m)) as stop from (select a, b, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), interval 1 month))::date as m from (select min(o_orderdate)::date as a, max(o_orderdate)::date as b from orders))")
add("prev_weekday", lambda s, d: T(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().select("day", sc.prev_weekday(F.col("day")).alias("prev"), F.date_add("day", 1).alias("next")), "select distinct o_orderdate::date as day, o_orderdate::date - case dayofweek(o_orderdate) when 1 then 3 when 0 then 2 else 1 end::int as prev, o_orderdate::date + 1 as next from orders")
add("yi_unit", lambda s, d: T(s, d, "orders").select("o_orderkey", sc.yi(F.when(F.col("o_orderkey") % 4 == 0, "abc").otherwise((F.col("o_custkey") * 1000000).cast("string"))).alias("yi")), "select o_orderkey, case when o_orderkey % 4 = 0 then 0 else round(o_custkey * 1000000 / 1e8, 2) end::double as yi from orders")
add("absolute_years", lambda s, d: T(s, d, "orders").select("o_orderkey", sc.absolute_year(F.when(F.col("o_orderkey") % 3 != 0, 1998), F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate"))).alias("y")), "select o_orderkey, case when p is not null and (c is null or p <= c) then p else c end as y from (select o_orderkey, case when o_orderkey % 3 != 0 then 1998 end as c, case when o_orderkey % 5 != 0 then year(o_orderdate)::int end as p from orders)")
add("clean_html", lambda s, d: T(s, d, "pages").select("page_id", F.md5(sc.clean_html(F.col("html"))).alias("text_md5")), r"""select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) as text_md5 from pages""")
add("html_counts", lambda s, d: T(s, d, "pages").select("page_id", F.aggregate(F.slice(F.regexp_extract_all("html", F.lit(r"track\(([0-9]+)\)"), F.lit(1)), 1, 30), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total")), r"select page_id, coalesce(list_sum(list_transform(regexp_extract_all(html, 'track\(([0-9]+)\)', 1)[1:30], lambda x: x::bigint)), 0)::bigint as total from pages")

# --- news: documents as items, events as their times ------------------------------
WORDS = {"policy": ["the", "General"], "global": ["de la", "les"], "event": ["token", "mit"], "risk": ["worthless", "scum"]}


def news(spark, sf_dir) -> DataFrame:
    docs, events = T(spark, sf_dir, "documents"), T(spark, sf_dir, "events")
    rows = docs.join(events.select("event_id", "ts"), docs.doc_id == events.event_id)
    return rows.select("doc_id", F.col("lang").alias("category"), F.col("ts").alias("time"), F.left("text", F.lit(40)).alias("title"), F.col("text").alias("summary"), "source")


NEWS = "news as (select doc_id, lang as category, ts as time, left(text, 40) as title, text as summary, source from documents join events on doc_id = event_id)"
_tag = ", ".join(f"case when regexp_matches(title || summary, '{'|'.join(w)}') then '{t}' end" for t, w in WORDS.items())
TAGGED = f"{NEWS},\ntagged as (select *, case when len(f) > 0 then f else [category] end as tags from (select *, list_filter([{_tag}], lambda x: x is not null) as f from news))"


def tagged(spark, sf_dir) -> DataFrame:
    return news(spark, sf_dir).withColumn("tags", tx.tags(F.concat("title", "summary"), WORDS, F.col("category")))


add("news_tags", lambda s, d: tagged(s, d).select("doc_id", F.array_join("tags", ",").alias("tags")), "select doc_id, array_to_string(tags, ',') as tags from tagged", TAGGED)
DAY = "2024-01-02"


def timed(spark, sf_dir) -> DataFrame:
    """News with times as feeds write them: two full forms, one without a year, none, prose."""
    form = lambda f: F.date_format("time", f)
    forms = F.array(form("yyyy-MM-dd HH:mm"), form("yyyy/MM/dd HH:mm:ss"), form("MM-dd HH:mm"), F.lit(None).cast("string"), F.concat(F.lit("posted "), form("yyyy-MM-dd")))
    return news(spark, sf_dir).select("doc_id", F.element_at(forms, (F.col("doc_id") % 5 + 1).cast("int")).alias("time"))


TIMED = f"""{NEWS},
timed as (select doc_id, ([strftime(time, '%Y-%m-%d %H:%M'), strftime(time, '%Y/%m/%d %H:%M:%S'), strftime(time, '%m-%d %H:%M'), null, 'posted ' || strftime(time, '%Y-%m-%d')])[(doc_id % 5 + 1)::int] as time from news)"""


def _window_sql(day: str, rows: str) -> str:
    return f"""select doc_id, time from (select *, bool_or(near) over () as hits from (select *, case when coalesce(time, '') = '' then true
  when read is not null then abs(epoch(read) - epoch(timestamp '{day}')) <= 172800 else contains(time, '{day}') end as near
  from (select *, coalesce(try_strptime(replace(time, '/', '-'), ['%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S']), try_strptime('{day[:4]}-' || replace(time, '/', '-'), '%Y-%m-%d %H:%M')) as read from {rows}))) where near or not hits"""


add("news_window", lambda s, d: tx.news_window(timed(s, d), DAY), _window_sql(DAY, "timed"), TIMED)
add("news_window_empty", lambda s, d: tx.news_window(timed(s, d).where("time like '____-%'"), "1999-05-05"), _window_sql("1999-05-05", "(select * from timed where time like '____-%')"), TIMED)
add("news_dedupe", lambda s, d: tx.news_rank(tx.first_per_key(news(s, d).withColumn("k", F.left("title", F.lit(24))), ["k"], "time", "doc_id").withColumn("tag", F.explode(tx.tags(F.concat("title", "summary"), WORDS, F.col("category")))), {"event": 8, "risk": 8}).select("tag", "rank", "doc_id"),
    "select tag, rank, doc_id from (select *, row_number() over (partition by tag order by time desc, title, doc_id) as rank from (select unnest(tags) as tag, * from (select *, row_number() over (partition by left(title, 24) order by time, doc_id) as rn from tagged) where rn = 1)) where rank <= case when tag in ('event', 'risk') then 8 else 10 end", TAGGED)
_key = "regexp_replace(title, '[^0-9A-Za-z\\x{4e00}-\\x{9fa5}]', '', 'g')[1:12]"
_bare = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
add("title_key", lambda s, d: news(s, d).select("doc_id", sc.title_key(F.col("title")).alias("key")), f"select doc_id, {_key} as key from news", NEWS)
add("news_clean", lambda s, d: tx.news_clean(news(s, d), DAY).groupBy("category").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.count_if(F.col("summary") == "").alias("blank")),
    f"select category, count(*) as n, sum(doc_id)::bigint as ids, count(*) filter (s = '') as blank from (select *, case when {_bare('summary')} in ('', {_bare('title')}) then '' else summary end as s, {_key} as key from news where {_bare('title')} != '' and time::date <= date '{DAY}') q where key = '' or doc_id = (select first(doc_id order by time, title) from (select *, {_key} as key from news where {_bare('title')} != '' and time::date <= date '{DAY}') r where r.category = q.category and r.key = q.key) group by category", NEWS)
add("news_sector_share", lambda s, d: _share(tagged(s, d)), "select tag, n, round(n / sum(n) over (), 6)::double as share from (select tag, count(*) as n from (select unnest(tags) as tag from tagged) group by tag)", TAGGED)
add("popularity_by_sector", lambda s, d: _popular(s, d), "select category, count(*) as n from news where source in (select source from (select category, source, row_number() over (partition by category order by source) as r from (select distinct category, source from news)) x where r <= 3 and x.category = news.category) group by category", NEWS)
add("title_filter", lambda s, d: news(s, d).where(F.col("title").rlike("^[A-E]") & ~F.col("title").rlike("the|der")).select("doc_id"), "select doc_id from news where regexp_matches(title, '^[A-E]') and not regexp_matches(title, 'the|der')", NEWS)


def _share(rows: DataFrame) -> DataFrame:
    n = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return n.select("tag", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def _popular(spark, sf_dir) -> DataFrame:
    rows = news(spark, sf_dir)
    top = rows.select("category", "source").distinct().withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("source"))).where("r <= 3").drop("r")
    return rows.join(top, ["category", "source"]).groupBy("category").agg(F.count("*").alias("n"))
