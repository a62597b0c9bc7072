"""Queries of disclosure texts and of the scan that merges them with fundamentals.

The texts are drafts and notices put together from each order's own values; the SQL
puts the same texts together and then reads them with patterns of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as sc
from ..operators import disclosures as dc, text as tx
from . import fundamentals as fd
from .fundamentals import T
from .sql import with_

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(key: str, run, body: str, ctes: str = "") -> None:
    QUERIES[key] = run
    ORACLE_SQL[key] = with_(ctes, body) if ctes else body


# --- texts --------------------------------------------------------------------------
#: Sentences with places for a year, the year two before, an amount and two percentages.
OPENINGS = {"F": "公司层面业绩考核目标：", "O": "子公司层面业绩考核目标：", "P": ""}
TARGETS = (
    "{y}年净利润不低于{a}亿元。", "公司{y}年营业收入相比考核基数增长不低于{p}%。", "以{a}万元为基数，{y}年净利润增长率不低于{p}%。",
    "如下表所示：营业收入增长率（A）净利润增长率（B）触发值（An）目标值（Am）触发值（Bn）目标值（Bm）第一个行权期{y}年{p}%{p}.5%{q}%{q}.5%。",
    "{y}年净利润较{b}年增长不低于{q}%。", "", "{y}年归属于上市公司股东的净利润增长率不低于{q}%。",
)
EXTRAS = ("", "{y}年营业收入不少于{a}万元。", "上述净利润指剔除本次股份支付费用的影响。", "至少满足下列两个条件之一。")
NEWS = (
    "公司已实现小批量供货，已送样。", "框架协议签署，尚未量产，处于中试阶段；产能爬坡中，正式订单，框架协议。", "尚未形成收入，仍在研发。",
    "已确认收入，框架协议不具有法律效力。", "",
)
SOURCES = ("announcement", "relation", "irm_question", "irm_answer")


def _filled(sentence: str) -> Column:
    values = {"y": (F.year("o_orderdate") + 10).cast("string"), "b": (F.year("o_orderdate") + 8).cast("string"), "a": F.floor(F.col("o_totalprice") / 1000).cast("string"),
              "p": (F.col("o_orderkey") % 40 + 1).cast("string"), "q": (F.col("o_custkey") % 30 + 1).cast("string")}
    parts = sentence.replace("{", "\0").replace("}", "\0").split("\0")
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def filings(spark, sf_dir) -> DataFrame:
    """(doc_id, code, date, source, url, text): one text for each order."""
    one = F.element_at(F.array(*map(_filled, TARGETS)), (F.col("o_custkey") % len(TARGETS) + 1).cast("int"))
    two = F.element_at(F.array(*map(_filled, EXTRAS)), (F.col("o_orderkey") % len(EXTRAS) + 1).cast("int"))
    two = F.when(F.col("o_orderkey") % 5 == 0, one).otherwise(two)  # summary and body say the same
    opening = F.when(F.col("o_orderstatus") == "F", OPENINGS["F"]).when(F.col("o_orderstatus") == "O", OPENINGS["O"]).otherwise("")
    news = F.element_at(F.array(*map(F.lit, NEWS)), ((F.col("o_custkey") + F.col("o_orderkey")) % len(NEWS) + 1).cast("int"))
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("o_orderkey") % 7 % len(SOURCES) + 1).cast("int"))
    return T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("date"), source.alias("source"),
                                             F.concat(F.lit("filings/"), "o_orderkey").alias("url"), F.concat(opening, one, two, news).alias("text"))


def _sql_filled(sentence: str) -> str:
    values = {"y": "(year(o_orderdate) + 10)", "b": "(year(o_orderdate) + 8)", "a": "floor(o_totalprice / 1000)::bigint", "p": "(o_orderkey % 40 + 1)", "q": "(o_custkey % 30 + 1)"}
    parts = sentence.replace("{", "\0").replace("}", "\0").split("\0")
    return "concat(" + ", ".join(values[x] if i % 2 else f"'{x}'" for i, x in enumerate(parts)) + ")"


_one = f"([{', '.join(map(_sql_filled, TARGETS))}])[(o_custkey % {len(TARGETS)} + 1)::int]"
_two = f"case when o_orderkey % 5 = 0 then {_one} else ([{', '.join(map(_sql_filled, EXTRAS))}])[(o_orderkey % {len(EXTRAS)} + 1)::int] end"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
FILINGS = f"""
filings as (
  select o_orderkey as doc_id, o_custkey as code, o_orderdate::date as date, ({_list(SOURCES)})[(o_orderkey % 7 % {len(SOURCES)} + 1)::int] as source, 'filings/' || o_orderkey as url,
    case o_orderstatus when 'F' then '{OPENINGS["F"]}' when 'O' then '{OPENINGS["O"]}' else '' end || {_one} || {_two} || ({_list(NEWS)})[((o_custkey + o_orderkey) % {len(NEWS)} + 1)::int] as text
  from orders)"""

# --- targets ------------------------------------------------------------------------
_Y, _M, _N = "(20[0-9][0-9])年(?:公司)?", "((?:归属于上市公司股东的)?(?:净利润|营业收入))", "([0-9][0-9.]*)"
_UP = f"增长率?不低于{_N}%"
#: (kind, pattern, groups of year, metric, value, unit, basis amount, basis year), what is read first first.
_SQL_READINGS = (
    ("base_growth", f"以{_N}万元为基数，{_Y}{_M}{_UP}", 2, 3, 4, "'%'", 1, "null::int"),
    ("rel_year", f"{_Y}{_M}较{_Y}{_UP}", 1, 2, 4, "'%'", None, 3),
    ("rel_named", f"{_Y}{_M}相比考核基数{_UP}", 1, 2, 3, "'%'", None, "null::int"),
    ("bare_growth", f"{_Y}{_M}{_UP}", 1, 2, 3, "'%'", None, "year - 1"),
    ("abs", f"{_Y}{_M}(?:不低于|不少于){_N}([万亿]元)", 1, 2, 3, 4, None, "null::int"),
)
_BASIS = {"base_growth": "'amount'", "rel_year": "'year'", "bare_growth": "'year'", "rel_named": "'base'"}


def _sql_targets() -> str:
    """Each reading takes its statements out of the text before the next one reads it."""
    ctes, text = [], "filings"
    for kind, pattern, year, metric, value, unit, amount, basis_year in _SQL_READINGS:
        g = lambda k, pattern=pattern: f"unnest(regexp_extract_all(text, '{pattern}', {k}))"
        ctes.append(f"""
{kind}_found as (select doc_id, '{kind}' as kind, {g(year)}::int as year, {g(metric)} as metric_raw, {g(value)}::double as value,
    {g(unit) if isinstance(unit, int) else unit} as unit, {_BASIS.get(kind, 'null')}::varchar as basis_kind, {f'{g(amount)}::double' if amount else 'null::double'} as basis_amount,
    {f'{g(basis_year)}::int' if isinstance(basis_year, int) else ('null::int' if 'year' not in basis_year else '-1')} as basis_year from {text}),
{kind}_rest as (select doc_id, regexp_replace(text, '{pattern}', '　', 'g') as text from {text})""")
        text = f"{kind}_rest"
    union = " union all ".join(f"select * from {r[0]}_found" for r in _SQL_READINGS)
    return ",".join(ctes) + f",\nfound as (select * replace (case when basis_year = -1 then year - 1 else basis_year end as basis_year) from ({union}))"


FOUND = FILINGS + "," + _sql_targets()
CELLS = """
tables as (select doc_id, regexp_extract_all(text, '(触发值|目标值)（([A-Za-z]+)）', 1) as tiers, regexp_extract_all(text, '(触发值|目标值)（([A-Za-z]+)）', 2) as codes,
    regexp_extract_all(text, '(营业收入增长率|净利润增长率)（([A-Z])）', 1) as names, regexp_extract_all(text, '(营业收入增长率|净利润增长率)（([A-Z])）', 2) as of,
    unnest(regexp_extract_all(text, '(第.个行权期)(20[0-9][0-9])年((?:[0-9.]+%)+)', 1)) as label, unnest(regexp_extract_all(text, '(第.个行权期)(20[0-9][0-9])年((?:[0-9.]+%)+)', 2))::int as year,
    unnest(regexp_extract_all(text, '(第.个行权期)(20[0-9][0-9])年((?:[0-9.]+%)+)', 3)) as row from filings),
cells as (select doc_id, label, year, j::int as column, tiers[j] as tier, codes[j] as code, names[list_position(of, codes[j][1])] as metric, string_split(row, '%')[j]::double as value
  from tables, unnest(range(1, 5)) as u(j))"""
_class = lambda c: f"case when {c} like '%净利润%' then 'net profit' when {c} like '%营业收入%' then 'revenue' else 'other' end"
PERIODS = f"""{FOUND},{CELLS},
periods as (
  select doc_id, kind, year, metric_raw, '>=' as op, value, unit, null::varchar as tier from found
  union all select doc_id, 'matrix', year, metric, '>=', value, '%', tier from cells),
told as (select distinct * from periods),
plans as (
  select f.*, coalesce(primary_raw, '') as metric_raw, {_class("coalesce(primary_raw, '')")} as metric,
    case when primary_raw is null then '' when kinds = 3 then 'matrix+regex' when kinds = 2 then 'matrix' else 'regex' end as path,
    case when text like '%至少满足下列两个条件之一%' then 'or' else 'and' end as connector,
    case when text like '%股份支付费用%' then 'interval' else 'point' end as gap_kind,
    case when text like '%子公司层面业绩考核目标%' then 'subsidiary' else 'company' end as scheme,
    case when text like '%业绩考核目标%' then 'explicit' else 'default' end as scheme_source
  from filings f left join (select doc_id, min_by(metric_raw, (metric_raw not like '%净利润%', length(metric_raw), metric_raw)) as primary_raw,
      2 * max((kind = 'matrix')::int) + max((kind != 'matrix')::int) as kinds from told group by doc_id) p using (doc_id))"""

BASIS = ("basis_kind", "basis_amount", "basis_year")
add("target_extract", lambda s, d: dc.targets(filings(s, d)).select("doc_id", "kind", "year", "metric_raw", "op", "value", "unit", *BASIS), "select doc_id, kind, year, metric_raw, '>=' as op, value, unit, basis_kind, basis_amount, basis_year from found", FOUND)
add("target_matrix", lambda s, d: dc.target_matrix(filings(s, d)).drop("at", "to"), "select * from cells", f"{FILINGS},{CELLS}")
add("target_dedupe", lambda s, d: dc.target_dedupe(filings(s, d)).select("doc_id", "kind", "year", "metric_raw", "op", "value", "unit", "tier", "metric", "primary_raw", F.col("primary").alias("primary_class")),
    f"select t.*, {_class('t.metric_raw')} as metric, p.metric_raw as primary_raw, p.metric as primary_class from told t join plans p using (doc_id)", PERIODS)
add("target_scope", lambda s, d: dc.with_scope(filings(s, d)).select("doc_id", "scheme", "scheme_source"), "select doc_id, scheme, scheme_source from plans", PERIODS)
add("coverage_report", lambda s, d: dc.coverage(dc.target_plan(filings(s, d))),
    """select case when grouping(p) = 1 and grouping(m) = 1 then 'all' when grouping(p) = 0 then 'path' else 'metric' end as "group",
  case when grouping(p) = 1 and grouping(m) = 1 then '' else coalesce(p, m, 'none') end as name, count(*) as total, count(p) as extracted, round(count(p)::double / count(*), 4) as rate
from (select nullif(path, '') as p, case when path != '' then metric end as m from plans) group by grouping sets ((p), (m), ())""", PERIODS)  # fmt: skip
add("coverage_misses", lambda s, d: dc.misses(dc.target_plan(filings(s, d)), "url"),
    "select doc_id, code, url as link, case when text like '%业绩考核目标%' or text like '%如下表所示%' then 'no pattern found' else 'no anchor' end as reason from plans where path = ''", PERIODS)

# --- milestones ---------------------------------------------------------------------
_stages = [f"({'|'.join(words)})" for words in dc.STAGE_WORDS]
GRADED = f"""
plain as (select *, regexp_replace(text, '(?:{'|'.join(sorted(dc.NEGATIONS, key=len, reverse=True))})[^。；;，,]{{0,12}}', '　', 'g') as bare from filings where source != '{dc.QUESTION}'),
levels as (select *, case {' '.join(f"when regexp_matches({'replace(bare, ' + repr('小批量') + ', ' + repr('　') + ')' if k == 4 else 'bare'}, '{_stages[k - 1]}') then {k}" for k in (5, 4, 3, 2, 1))} else 0 end as level from plain),
graded as (select *, level >= {dc.REALISED} as realised, ({_list(("unknown", *dc.STAGES))})[level + 1] as stage,
    array_to_string(regexp_extract_all(replace(bare, case when level = 4 then '小批量' else chr(1) end, '　'), ({_list(['$^', *_stages])})[level + 1], 0), ',') as terms from levels)"""


def words() -> Column:
    return F.array_join(F.transform("terms", lambda t: t["said"]), ",").alias("terms")


add("milestone_grade", lambda s, d: dc.graded(filings(s, d), "source").select("doc_id", "level", "stage", "realised", words()), "select doc_id, level, stage, realised, terms from graded", f"{FILINGS},{GRADED}")
add("milestone_sentence", lambda s, d: filings(s, d).select("doc_id", tx.sentence(F.col("text"), "供货", 6).alias("said")),
    "select doc_id, case when strpos(text, '供货') > 0 then text[greatest(strpos(text, '供货') - 6, 1):strpos(text, '供货') + 5] else '' end as said from filings", FILINGS)
_count = lambda words: " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words)
add("trap_counts", lambda s, d: filings(s, d).select("doc_id", tx.traps(F.col("text")).alias("t")).select("doc_id", *[F.col("t")[k].alias(k.replace(" ", "_")) for k in tx.TRAPS]),
    f"select doc_id, {', '.join(f'({_count(w)})::int as {k.replace(chr(32), chr(95))}' for k, w in tx.TRAPS.items())} from filings", FILINGS)
add("milestone_latest", lambda s, d: dc.evidence(filings(s, d)).select("code", "n", "rank", "latest", "date", "level", "stage", "realised", "doc_id", words()),
    "select code, count(*) over (partition by code) as n, row_number() over (partition by code order by date nulls first, level, doc_id) as rank, rank = n as latest, date, level, stage, realised, doc_id, terms from graded where level > 0", f"{FILINGS},{GRADED}")
add("answer_side", lambda s, d: tx.answers(T(s, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last")), "select conv_id, count(*) as n, max(turn) as last from conversations where role = 'assistant' and length(trim(coalesce(text, ''))) > 0 group by conv_id")
IMPLIED = "implied as (select doc_id, min(year) as year, round(min_by(value, (year, value)) / 100, 6) as growth from told where unit = '%' group by doc_id)"


def implied_growth(plans: DataFrame) -> DataFrame:
    """plans with implied_year and implied: the earliest percentage target as a fraction."""
    first = F.get(F.filter("periods", lambda p: p["unit"] == "%"), F.lit(0))
    return plans.withColumn("implied_year", first["year"]).withColumn("implied", F.round(first["value"] / 100, 6))


add("implied_growth", lambda s, d: implied_growth(dc.target_plan(filings(s, d))).where("implied is not null").select("doc_id", F.col("implied_year").alias("year"), F.col("implied").alias("growth")), "select * from implied", f"{PERIODS},\n{IMPLIED}")

# --- the scan -----------------------------------------------------------------------
#: Forecast years lie ten years after the revenue that stands for them; the cut of the registered queries.
AHEAD, AS_OF = 10, "1995-06-30"


def forecasts(spark, sf_dir) -> DataFrame:
    """(code, year, eps, eps_before): forecasts by year, and those of a month before."""
    eps = fd.financials(spark, sf_dir).groupBy("code", (F.year("q") + AHEAD).alias("year")).agg(F.sum("rev").alias("eps"))
    return eps.withColumn("eps_before", F.col("eps") * (1 + (F.col("code") % 7 - 3) / 10.0))


def merged(spark, sf_dir, as_of: str) -> DataFrame:
    """One row for each code that has a draft or a milestone by the day: the last draft
    with a target, the latest milestone, consensus growth of the target's year,
    surprise and tightness of the financials, and the forecasts' revision; `sources` tells
    which of the five there are. Codes meet by outer joins of per-code tables."""
    known = filings(spark, sf_dir).where((F.col("date") <= F.lit(as_of).cast("date")) & F.col("code").isNotNull())
    drafts = implied_growth(dc.target_plan(known)).where("path != ''")
    drafts = drafts.select("code", "date", F.struct("date", "doc_id", "metric", "scheme", "connector", "requires_manual", "gap_kind", "implied_year", "implied").alias("plan"))
    drafts = drafts.groupBy("code").agg(F.max_by("plan", F.struct("plan.date", "plan.doc_id")).alias("plan"))
    notes = dc.graded(known, "source").where("level > 0").select("code", F.struct("date", "level", "doc_id", "stage", "realised", tx.traps(F.col("text")).alias("traps")).alias("note"))
    notes = notes.groupBy("code").agg(F.max_by("note", F.struct("note.date", "note.level", "note.doc_id")).alias("note"), F.count("*").alias("evidence"))
    fin = fd.financials(spark, sf_dir).where(F.col("q") <= F.lit(as_of).cast("date"))
    eps = forecasts(spark, sf_dir)
    now, before = eps.select("code", "year", "eps"), eps.select("code", (F.col("year") + 1).alias("year"), F.col("eps").alias("was"))
    growth = now.join(before, ["code", "year"]).where("was != 0").select("code", F.col("year").alias("implied_year"), ((F.col("eps") - F.col("was")) / F.abs("was")).alias("consensus"))
    near = eps.where(F.col("year") >= F.year(F.lit(as_of).cast("date"))).groupBy("code").agg(F.min_by(F.struct("eps", "eps_before"), "year").alias("m"))
    revision = near.where("m.eps_before != 0").select("code", ((F.col("m.eps") - F.col("m.eps_before")) / F.abs("m.eps_before")).alias("revision"))
    rows = drafts.join(notes, "code", "full").withColumn("implied_year", F.col("plan.implied_year"))
    rows = rows.join(growth, ["code", "implied_year"], "left").join(fd.sue(fin), "code", "left").join(revision, "code", "left")
    rows = rows.join(recent(fin), "code", "left")
    tight = F.when(F.col("plan.implied") > F.col("recent") * 1.15, "above").when(F.col("plan.implied") < F.col("recent") * 0.75, "below").when(F.col("plan.implied").isNotNull() & F.col("recent").isNotNull(), "near")
    present = {"targets": "plan", "milestones": "note", "consensus": "consensus", "financials": "sue", "forecasts": "revision"}
    sources = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), n) for n, c in present.items()])), ",")
    return rows.withColumn("tightness", F.coalesce(tight, F.lit("unknown"))).withColumn("sources", sources)


def recent(fin: DataFrame) -> DataFrame:
    """(code, recent): the mean of the last two yoy, as a fraction."""
    rows = fin.where("yoy is not null").withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("q")))).where("_r <= 2")
    return rows.groupBy("code").agg((F.avg("yoy") / 100).alias("recent"))


def scan(spark, sf_dir, as_of: str = AS_OF) -> DataFrame:
    """Both scores of every code of merged(), with what needs a reader's eye as an array
    and where each part came from."""
    c = F.col
    rows = merged(spark, sf_dir, as_of).withColumn("gap", sc.half_up(c("plan.implied") - c("consensus"), 3))
    metric, traps = F.coalesce("plan.metric", F.lit("")), c("note.traps")
    a = sc.score_a(sc.half_up(c("revision"), 3), sc.half_up(c("sue"), 3), c("gap"))
    number = lambda *names: F.coalesce(sum((traps[n] for n in names), F.lit(0)), F.lit(0))
    b = sc.score_b(F.coalesce("note.level", F.lit(0)), metric, F.array(metric), c("tightness"), number("framework", "intent"), number("not binding"), F.coalesce("plan.scheme", F.lit("company")), F.coalesce("plan.connector", F.lit("and")))
    manual = F.array_compact(F.array(F.when(c("plan").isNull(), "no target extracted"), F.when(c("note").isNull(), "no milestone evidence"), F.when(c("plan.requires_manual"), F.concat(F.lit("no profit gap from "), metric))))
    rows = rows.withColumn("x", a).withColumn("b", b)
    return rows.select("code", c("x.score").alias("a"), "b", c("x.rankable").alias("rankable"), c("x.n").alias("n_parts"), F.round("gap", 3).alias("gap"), "tightness", c("plan.metric").alias("metric"), c("plan.doc_id").alias("draft"),
                       F.coalesce("note.stage", F.lit("unknown")).alias("stage"), F.coalesce("note.realised", F.lit(False)).alias("realised"), c("note.doc_id").alias("notice"), F.coalesce("evidence", F.lit(0)).alias("evidence"), manual.alias("manual"), "sources")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first rows: rankable ones, then by both scores, then by code (a top-k report)."""
    order = [F.col("rankable").desc(), F.desc("a"), F.desc("b"), "code"]
    best = rows.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


_traps = lambda *names: " + ".join(_count(tx.TRAPS[n]) for n in names)
SCAN = f"""{PERIODS},
{IMPLIED},{GRADED},
{fd.FIN},
known as (select * from fin where q <= date '{AS_OF}'),
drafts as (select code, max_by({{'doc_id': doc_id, 'metric': metric, 'scheme': scheme, 'connector': connector, 'year': i.year, 'implied': i.growth}}, (date, doc_id)) as plan
  from plans left join implied i using (doc_id) where path != '' and code is not null and date <= date '{AS_OF}' group by code),
notes as (select code, count(*) as evidence, max_by({{'doc_id': doc_id, 'level': level, 'stage': stage, 'realised': realised, 'traps': {_traps('framework', 'intent')}, 'soft': {_traps('not binding')}}}, (date, level, doc_id)) as note
  from graded where level > 0 and code is not null and date <= date '{AS_OF}' group by code),
forecast as (select code, (year(q) + {AHEAD})::int as year, sum(rev) as eps from fin group by all),
growth as (select n.code, n.year, (n.eps - b.eps) / abs(b.eps) as consensus from forecast n join forecast b on b.code = n.code and b.year = n.year - 1 where b.eps != 0),
revised as (select code, (a - b) / abs(b) as revision from (select code, min_by(eps, year) as a, min_by(eps * (1 + (code % 7 - 3) / 10.0), year) as b from forecast where year >= year(date '{AS_OF}') group by code) where b != 0),
recent as (select code, avg(yoy) / 100 as recent from (select *, row_number() over (partition by code order by q desc) as r from known where yoy is not null) where r <= 2 group by code),
{fd.SUE.replace('from fin where', 'from known where')},
one as (select *, coalesce(drafts.code, notes.code) as owner from drafts full join notes on drafts.code = notes.code),
parts as (
  select owner as code, plan, note, evidence, round(revision, 3) as rev, round(sue.sue, 3) as sue, round(plan.implied - consensus, 3) as gap, consensus,
    case when plan.implied > recent * 1.15 then 'above' when plan.implied < recent * 0.75 then 'below' when plan.implied is not null and recent is not null then 'near' else 'unknown' end as tightness
  from one left join growth on growth.code = owner and growth.year = plan.year left join sue on sue.code = owner left join revised on revised.code = owner left join recent on recent.code = owner),
first as (select *, {fd.A_SQL}),
bin as (select *, coalesce(note.level, 0) as level, coalesce(plan.metric, '') as metric, coalesce(note.traps, 0) as traps, coalesce(note.soft, 0) as soft, coalesce(plan.scheme, 'company') as scheme, coalesce(plan.connector, 'and') as connector from first),
scanned as (
  select code, a, {fd.B_SQL.replace(' as score' + chr(10), ' as b, rankable, n as n_parts, gap, tightness, plan, note, evidence, rev, sue, consensus' + chr(10))}),
scan as (
  select code, a, b, rankable, n_parts, gap, tightness, plan.metric as metric, plan.doc_id as draft, coalesce(note.stage, 'unknown') as stage, coalesce(note.realised, false) as realised, note.doc_id as notice,
    coalesce(evidence, 0) as evidence,
    array_to_string(list_filter([case when plan is null then 'no target extracted' end, case when note is null then 'no milestone evidence' end, case when plan.metric = 'other' then 'no profit gap from other' end], lambda x: x is not null), ';') as manual,
    array_to_string(list_filter([case when plan is not null then 'targets' end, case when note is not null then 'milestones' end, case when consensus is not null then 'consensus' end, case when sue is not null then 'financials' end, case when rev is not null then 'forecasts' end], lambda x: x is not null), ',') as sources
  from scanned),
ranked as (select *, row_number() over (order by rankable desc, a desc, b desc, code) as rank from scan)""".replace("as score, n, n >= 2", "as a, n, n >= 2")


def told(rows: DataFrame) -> DataFrame:
    return rows.withColumn("manual", F.array_join("manual", ";"))


add("scan_topn", lambda s, d: told(ranked(scan(s, d), 30)), "select * from ranked where rank <= 30", SCAN)
add("join_scan_full", lambda s, d: told(scan(s, d)), "select * from scan", SCAN)
add("rank_two_level", lambda s, d: ranked(scan(s, d), 10).select("code", "a", "b", "rankable", "rank"), "select code, a, b, rankable, rank from ranked where rank <= 10", SCAN)
add("anti_resume", lambda s, d: filings(s, d).select("doc_id", "code").join(T(s, d, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("doc_id")), "doc_id", "left_anti"), "select doc_id, code from filings where doc_id not in (select l_orderkey from lineitem where l_linenumber = 2)", FILINGS)
