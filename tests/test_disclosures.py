"""Targets, matrices, scopes and milestones: fixed cases, offsets, edge rows."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import disclosures as dc

DOC = "doc_id long, code string, text string"
TABLE = (
    "业绩考核目标如下表所示：行权期考核年度营业收入增长率（A）净利润增长率（B）触发值（An）目标值（Am）触发值（Bn）目标值（Bm）"
    "第一个行权期2026年14.18%26.87%20.69%34.10%第二个行权期2027年15%28%22%36%"
)
TARGETS = [
    ("本激励计划2026年净利润不低于2.50亿元。", ("abs", 2026, "净利润", 2.5, "亿元", None, None, None)),
    ("公司2026年营业收入相比考核基数增长不低于15%。", ("rel_named", 2026, "营业收入", 15.0, "%", "base", None, None)),
    ("2027年度净利润不低于人民币5,000万元。", ("abs", 2027, "净利润", 5000.0, "万元", None, None, None)),
    ("2026-2027年营业收入累计不低于70.00亿元。", ("abs", 2026, "营业收入", 70.0, "亿元", None, None, None)),
    ("2026年净利润相比2024年增长率不低于30%。", ("rel_year", 2026, "净利润", 30.0, "%", "year", None, 2024)),
    ("2026年净利润较2024年净利润，增长不低于30.5%。", ("rel_year", 2026, "净利润", 30.5, "%", "year", None, 2024)),
    ("以1,200.5万元为基数，2026年净利润增长率不低于10%。", ("base_growth", 2026, "净利润", 10.0, "%", "amount", 1200.5, None)),
    ("以3亿元为基数，2026年增长率不低于10%。", ("base_growth", 2026, "", 10.0, "%", "amount", 3.0, None)),
    ("2026年归属于上市公司股东的净利润增长率不低于8%。", ("bare_growth", 2026, "归属于上市公司股东的净利润", 8.0, "%", "year", None, 2025)),
    ("2026年公司矿产资源业务毛利润不少于2亿元", ("abs", 2026, "矿产资源业务毛利润", 2.0, "亿元", None, None, None)),
]


def frame(spark, *texts):
    return spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], DOC)


@pytest.mark.parametrize(("text", "want"), TARGETS)
def test_one_statement_for_each_span(spark, text, want):
    rows = dc.targets(frame(spark, "前文。" + text, None, "")).collect()
    assert [(r.kind, r.year, r.metric_raw, r.value, r.unit, r.basis_kind, r.basis_amount, r.basis_year) for r in rows] == [want]
    said = ("前文。" + text)[rows[0].at : rows[0].to]
    assert said[-1] in "元%" and said.startswith(("20", "以")) and rows[0].op == ">="


def test_what_is_no_statement(spark):
    texts = ("2026年净利润为5亿元。", "净利润不低于5亿元。", "2026年目标：净利润预计不低于5亿元", "2026年净利润不低于", "不低于5%", "x" * 200_000)
    assert dc.targets(frame(spark, *texts)).count() == 0


def test_duplicates_and_primary_metric(spark):
    one, two = "2026年净利润不低于2.50亿元。", "2026年营业收入不低于9亿元。"
    rows = dc.target_plan(frame(spark, two + one + "……" + one, two, "2026年产出片数增长不低于5%", None)).orderBy("doc_id").collect()
    assert [(p.year, p.metric_raw, p.value) for p in rows[0].periods] == [(2026, "净利润", 2.5), (2026, "营业收入", 9.0)]
    assert (rows[0].metric_raw, rows[0].metric, rows[0].path, rows[0].confidence) == ("净利润", "net profit", "regex", "high")
    assert (rows[1].metric, rows[1].requires_manual) == ("revenue", False)
    assert (rows[3].path, rows[3].metric, rows[3].periods, rows[3].confidence) == ("", "other", [], None)
    assert dc.target_dedupe(frame(spark, two + one + one)).count() == 2


def test_matrix_with_tier_and_metric_names(spark):
    rows = dc.target_matrix(frame(spark, TABLE, "第一个行权期2026年14.18%26.87%", "触发值（An）第一个行权期2026年14.18%", "触发值" + "文" * 800 + "第一个行权期2026年1%2%", None)).orderBy("at", "column").collect()
    assert {r.doc_id for r in rows} == {0}  # no header, one cell, header too far
    revenue, profit = "营业收入增长率", "净利润增长率"
    assert [(r.year, r.column, r.tier, r.code, r.metric, r.value) for r in rows[:4]] == [
        (2026, 1, "触发值", "An", revenue, 14.18), (2026, 2, "目标值", "Am", revenue, 26.87), (2026, 3, "触发值", "Bn", profit, 20.69), (2026, 4, "目标值", "Bm", profit, 34.10),
    ]
    assert [(r.label, r.year, r.tier, r.value) for r in rows[4:]] == [("第二个行权期", 2027, t, v) for t, v in (("触发值", 15.0), ("目标值", 28.0), ("触发值", 22.0), ("目标值", 36.0))]
    plan = dc.target_plan(frame(spark, TABLE)).first()
    assert plan.path == "matrix" and plan.confidence == "medium" and plan.metric == "net profit" and len(plan.tiers) == 4


def test_connector_and_share_pay(spark):
    note = "2026年净利润不低于5.00亿元。上述“净利润”指经审计的归属于上市公司股东的净利润，并剔除本次及其它股权激励计划股份支付费用的影响。"
    rows = dc.target_plan(frame(spark, "至少满足下列两个条件之一：2026年营业收入不低于10亿元。", note, "2026年净利润不低于5亿元。上述净利润指合并数。股份支付费用另计。", None)).orderBy("doc_id").collect()
    assert [r.connector for r in rows] == ["or", "and", "and", "and"]
    assert [(r.share_pay, r.gap_kind) for r in rows] == [(False, "point"), (True, "interval"), (False, "point"), (False, "point")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("子公司层面业绩考核目标", ("subsidiary", "explicit")), ("公司层面业绩考核目标", ("company", "explicit")), ("没有", ("company", "default")), (None, ("company", "default")),
        ("子公司层面" + "文" * 90 + "业绩考核目标", ("company", "explicit")), ("控股子公司的业绩考核目标甲" + "文" * 100 + "业绩考核目标", ("company", "explicit")),
        ("控股子公司的考核目标" + "文" * 90 + "业绩考核目标", ("subsidiary", "heuristic")), ("控股子公司的考核目标" + "文" * 400 + "业绩考核目标", ("company", "explicit")),
        ("子公司层面业绩考核目标，子公司层面业绩考核目标，公司层面业绩考核目标", ("subsidiary", "explicit")), ("子公司层面业绩考核目标" + "文" * 90 + "公司层面业绩考核目标", ("company", "explicit")),
    ],
)
def test_scope(spark, text, want):
    row = dc.with_scope(frame(spark, text)).first()
    assert (row.scheme, row.scheme_source) == want and row.text == text


def test_coverage_and_misses(spark):
    plans = dc.target_plan(frame(spark, TARGETS[0][0], "业绩考核目标见附件", TABLE, None)).withColumn("url", F.concat(F.lit("u"), "code"))
    by = {(r.group, r.name): (r.total, r.extracted, r.rate) for r in dc.coverage(plans).collect()}
    assert by["all", ""] == (4, 2, 0.5) and by["path", "regex"] == (1, 1, 1.0) and by["path", "matrix"] == (1, 1, 1.0)
    assert by["metric", "net profit"] == (2, 2, 1.0) and by["path", "none"] == (2, 0, 0.0)
    assert sorted((r.doc_id, r.link, r.reason) for r in dc.misses(plans, "url").collect()) == [(1, "uc1", "no pattern found"), (3, "uc3", "no anchor")]


@pytest.mark.parametrize(
    ("text", "stage", "realised", "terms"),
    [
        ("公司半固态电芯已进入中试试验，中试试验已出样品。", "pilot", False, ["中试", "中试", "已出样品"]), ("客户送样，未形成批量订单。", "sample", False, ["送样"]),
        ("公司已实现批量供货，产能爬坡中。", "mass production", True, ["批量供货", "产能爬坡"]), ("公司已实现小批量供货。", "small batch", False, ["小批量"]), ("已小批量交付。", "small batch", False, ["小批量"]),
        ("已确认收入并计入当期。", "revenue", True, ["确认收入"]), ("尚在研发中，存在不确定性。", "unknown", False, []), ("尚未量产，仍处于中试。已送样。", "pilot", False, ["中试"]), ("尚未量产送样", "unknown", False, []), (None, "unknown", False, []),
    ],
)
def test_milestones(spark, text, stage, realised, terms):
    row = dc.graded(frame(spark, text)).first()
    assert (row.stage, row.realised, [t.said for t in row.terms]) == (stage, realised, terms)
    assert all(text[t.at : t.at + len(t.said)] == t.said for t in row.terms) and (row.sentence in (text or "")) and (bool(row.sentence) == bool(terms))


def test_evidence_is_all_kept_and_questions_are_rejected(spark):
    rows = [("X", "relation", "2026-01-05", 1, "已送样。"), ("X", "relation", "2026-08-05", 2, "已实现批量供货。"), ("X", "irm_question", "2026-09-05", 3, "公司产品处于小试还是中试？"), ("Y", None, None, 4, "已送样"), ("Y", "a", "2026-01-01", 5, None)]
    records = spark.createDataFrame(rows, "code string, source string, date string, doc_id long, text string")
    got = [(r.code, r.date, r.stage, r.rank, r.n, r.latest) for r in dc.evidence(records).orderBy("code", "rank").collect()]
    assert got == [("X", "2026-01-05", "sample", 1, 2, False), ("X", "2026-08-05", "mass production", 2, 2, True), ("Y", None, "sample", 1, 1, True)]


def test_repeated_rows_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "a", TARGETS[0][0]), (1, "a", TARGETS[0][0]), (None, "b", TABLE)], DOC)
    assert dc.targets(twice).count() == 2 and dc.target_matrix(twice).count() == 8 and dc.target_plan(twice).count() == 3
    none = spark.createDataFrame([], DOC)
    for f in (dc.targets, dc.target_matrix, dc.target_plan, dc.target_dedupe, dc.with_scope, dc.graded):
        assert f(none).isEmpty()


def test_scan_leaves_out_texts_and_ends_without_targets(spark):
    one, news = "2026年净利润不低于5亿元。", "2027年净利润为5亿元，已确认收入。" * 3
    docs = frame(spark, news, one + news, "第一个行权期2026年1%2%" + news)
    kinds = lambda needed: [[m.kind for m in r.marks] for r in dc.marked_targets(docs, needed).orderBy("doc_id").collect()]
    assert kinds(dc.STATEMENT) == [[], ["y", "m", "c", "a"], []]
    assert kinds(dc.ROW) == [[], [], ["l", "y", "p", "p", "y", "m"]]


def test_only_texts_with_statements_or_rows_reach_the_scanner(spark, monkeypatch):
    docs, seen, marked = frame(spark, "2026年净利润为5亿元。", "2026年净利润不低于5亿元。", TABLE, "", None), [], dc._marked
    monkeypatch.setattr(dc, "_marked", lambda docs, *rest: seen.append([r.text for r in docs.select("text").collect()]) or marked(docs, *rest))
    assert dc.targets(docs).count() == 1 and dc.target_matrix(docs).count() == 8
    assert seen == [["2026年净利润不低于5亿元。"], [TABLE]]


def test_arrays_are_read_once(spark):
    plan = dc.target_matrix(frame(spark, TABLE))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(") == 1 and "size(flatten" not in plan
