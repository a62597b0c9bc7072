"""Targets, matrices, scopes and milestones in disclosure texts.

A scanner marks every text once: each mark has its offsets, a letter for its kind and
what it says. The letters of a text's marks, joined, are its shape; a small grammar of
shapes (data, in order of priority) reads statements off it, each ending at one
comparison, so overlapping readings of one span yield the longest. What belongs to
a statement (headers, levels) is looked up by offset. The scanner is the one Python
step, over whole texts; all else is column expressions on the row's own marks, so no
text or mark is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Words of targets in disclosures.
HEADS = ("净利润", "营业收入", "收入合计")
OWNERS = ("扣除非经常性损益后的", "扣除非经常性损益后", "扣非", "归属于上市公司股东的", "归属于母公司股东的", "归母")
LINES = ("收入", "毛利润", "毛利")
AT_LEAST = ("不低于", "不少于")
GROWTH = ("增长率", "增长")
AGAINST = ("相较于", "相较", "相比于", "相比", "较于", "较")
BASES = ("考核基数", "基期", "基准年度", "基准年", "上年度", "上年")
AS_BASE = ("为基数", "作为基数")
UNITS = ("亿元", "万元", "元")
CURRENCY = "人民币"
VESTING = ("归属期", "行权期", "解除限售期", "解除限售安排", "解锁期")
TIERS = ("触发值", "目标值", "门槛值", "考核值", "行权系数")
ANCHOR, SHORT_ANCHOR, HELD = "业绩考核目标", "考核目标", "控股子公司"
SUBSIDIARY = ("子公司层面", "子公司业绩考核", "子公司考核目标")
COMPANY = ("公司层面", "公司业绩考核")
EITHER = ("至少满足下列两个条件之一", "满足其中之一", "或者", "；或", ";或")
#: (words, class) of metrics, the first that a metric holds.
ALIASES = (
    (("扣非", "扣除非经常性损益"), "core profit"), (("净利润",), "net profit"), (("营业收入", "收入合计"), "revenue"),
    (("毛利",), "gross profit"), (("片数", "产能", "出货量"), "output"), (("业务收入",), "line"),
)
#: Words of the five stages in order, negations, traps.
STAGES = ("sample", "pilot", "small batch", "mass production", "revenue")
STAGE_WORDS = (
    ("送样", "样品交付", "提交样品", "样件交付", "送检"), ("小试", "中试", "已出样品", "试产", "试验线", "试制"), ("小批量", "批量试产"),
    ("量产", "批量供货", "批量交付", "批量出货", "产能爬坡", "达产"), ("收入确认", "确认收入", "计入当期收入", "形成收入", "实现销售收入", "产生收入"),
)
NEGATIONS = (
    "尚未量产", "未量产", "未形成批量", "尚未形成收入", "未产生收入", "尚未产生收入", "不构成收入", "未实现收入", "仍在研发", "研发中",
    "不确定性", "尚在研发", "尚未签署", "无实质进展", "仅处于",
)
#: The level from which a stage counts as realised, and the source that asks instead of telling.
REALISED, QUESTION = 4, "irm_question"
#: Metric classes from which no profit gap follows.
UNCLEAR = ("other", "output", "line")

MARKS = ArrayType(StructType().add("at", IntegerType()).add("to", IntegerType()).add("kind", StringType()).add("said", StringType()))
HEADER, TIGHT, WIDE = 700, 80, 400


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


#: What every statement holds (a comparison), and every matrix row (its label).
STATEMENT, ROW = _any(AT_LEAST), f"第[一二三四五六七八九十]个{_any(VESTING)}"


def lexicon(lines: bool = True, codes: bool = True) -> list[tuple[str, str]]:
    """(letter of the kind, pattern) of target marks, tried in order at each place.

    Without lines the patterns that any words before a word of LINES or 片数 open are left
    out, without codes those that end in a bracketed code: a text that holds no such word,
    or no opening bracket, has none of them, and they are the ones tried at every character."""
    number, blank = r"[0-9][0-9,]*(?:\.[0-9]+)?", r"\s*"
    named = f"{_any(OWNERS)}*{_any(HEADS)}"
    code = rf"{blank}[（(]{blank}[A-Za-z]{{1,3}}{blank}[）)]"
    declared, metric = (named, named) if not lines else (f"(?:{named}|[一-龥]{{2,8}}?(?:片数|{'|'.join(LINES)}))", f"{named}|[一-龥]{{2,10}}?(?:业务)?{_any(LINES)}(?!增长?率?{code})")
    rows = [
        ("l", ROW),
        ("t", f"{_any(TIERS)}(?:{code})?"),
        ("d", f"{declared}增长?率?{code}"),
        ("p", rf"[0-9]+(?:\.[0-9]+)?{blank}%"),
        ("y", rf"20[0-9]{{2}}(?:-20[0-9]{{2}})?{blank}年?(?:度|累计)*{blank}(?:公司)?"),
        ("a", f"(?:{CURRENCY})?{blank}{number}{blank}(?:{CURRENCY})?{_any(UNITS)}"),
        ("m", metric),
        ("c", _any(AT_LEAST)),
        ("g", _any(GROWTH)),
        ("b", _any(BASES)),
        ("B", _any(AS_BASE)),
        ("v", _any(AGAINST)),
        ("f", "以"),
        ("u", "累计"),
    ]
    return [r for r in rows if codes or r[0] != "d"]


#: What may stand between the parts of a statement.
FILLER = re.compile(r"(?:[\s，,]|公司)*")
#: Readings of a shape, in order of priority: name and shape.
READINGS = (
    ("base_growth", "faB?ym?gcp"),
    ("rel_year", "ymvym?gcp"),
    ("rel_named", "ymvbgcp"),
    ("bare_growth", "ymgcp"),
    ("abs", "ymu?ca"),
)
LONGEST = 9


def _scan_targets(pattern: re.Pattern, text: str, final: int) -> list[tuple]:
    """Marks of a text in order; a gap that holds more than filler is a mark of kind x.

    final is where the last comparison or row label stands: a statement ends with the
    mark after its comparison, a row with its last percentage, so marks beyond those are
    not looked for."""
    out, last, row = [], 0, False
    for m in pattern.finditer(text):
        at, kind = m.start(), m.lastgroup
        if at != last and not FILLER.fullmatch(text, last, at):
            out.append((last, at, "x", ""))
        out.append((at, m.end(), kind, m.group()))
        last = m.end()
        if at == final:
            row = kind == "l"
        elif at > final and not (row and kind in ("y", "p")):
            break
    return out


def _scan_kinds(patterns: list[tuple[str, re.Pattern]], text: str) -> list[tuple]:
    """Marks of several kinds that may overlap, by offset. A pattern is wrapped in a
    look-ahead where its own places may overlap."""
    found = ((m.start(m.lastindex or 0), m.end(m.lastindex or 0), kind, m.group(m.lastindex or 0)) for kind, p in patterns for m in p.finditer(text))
    return sorted(found)


def _marked(docs: DataFrame, column: str, scan) -> DataFrame:
    """docs with a column of marks of its texts; null texts have none. `scan` comes
    back from a function, so that patterns are compiled in the task."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("kind", pa.string()), ("said", pa.string())]))
    names, kept = docs.columns, [n for n in docs.columns if n != column]
    schema = StructType([f for f in docs.schema if f.name != column]).add(column, MARKS)

    def run(batches):
        read = scan()
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column(names.index("text")).to_pylist():
                flat += read(t or "")
                ends.append(len(flat))
            parts = [pa.array(values, field.type) for values, field in zip(zip(*flat) if flat else ((),) * 4, kind.value_type, strict=True)]
            marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), marks], names=[*kept, column])

    return docs.mapInArrow(run, schema)


def marked_targets(docs: DataFrame, needed: str) -> DataFrame:
    """docs(.., text) with column marks: the marks of the target lexicon, up to the end
    of the last statement or row. `needed` is the pattern of their comparisons, labels or
    both; texts without it are not scanned and have no marks."""

    def scan():
        must, line = re.compile(needed), re.compile(_any(("片数", *LINES)))
        patterns = {(a, b): re.compile("|".join(f"(?P<{'base' if k == 'B' else k}>{p})" for k, p in lexicon(a, b))) for a in (False, True) for b in (False, True)}

        def read(text):
            final = max((m.start() for m in must.finditer(text)), default=-1)
            if final < 0:
                return []
            pattern = patterns[line.search(text) is not None, "（" in text or "(" in text]
            return [(a, b, "B" if k == "base" else k, s) for a, b, k, s in _scan_targets(pattern, text, final)]

        return read

    return _marked(docs, "marks", scan)


def _number(said: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(said, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").cast("double")


def _year(said: Column) -> Column:
    return F.left(said, F.lit(4)).cast("int")


def statements(marks: Column, shape: Column) -> Column:
    """Array of statements from a text's marks and their shape."""

    def read(i: Column) -> Column:
        """The statement whose comparison is mark i (from 1). The shapes are bound by
        transform: as plain columns they would be matched again wherever they are used."""
        low = F.greatest(i + 1 - (LONGEST - 1), F.lit(1))
        around = F.substring(shape, low, i + 2 - low)
        shapes = F.array(*[F.regexp_extract(around, f"({pattern})$", 1) for _, pattern in READINGS])
        return F.get(F.transform(F.array(shapes), lambda found: told(i, found)), F.lit(0))

    def told(i: Column, found: Column) -> Column:
        out = None
        for k, (name, _) in enumerate(READINGS):
            got = F.get(found, F.lit(k))
            first = i + 2 - F.length(got)
            part = lambda k, first=first: F.element_at(marks, first + k)
            at = F.instr(got, "y") - 1
            metric = F.when(F.substring(got, at + 2, 1) == "m", part(at + 1)["said"]).otherwise("")
            year, last = _year(part(at)["said"]), F.element_at(marks, i + 1)
            basis_year = {"rel_year": _year(part(F.lit(3))["said"]), "bare_growth": year - 1}.get(name, F.lit(None).cast("int"))
            amount = _number(part(F.lit(1))["said"]) if name == "base_growth" else F.lit(None).cast("double")
            basis = {"base_growth": "amount", "rel_year": "year", "bare_growth": "year", "rel_named": "base"}.get(name)
            unit = F.regexp_extract(last["said"], f"{_any(UNITS)}$", 0) if name == "abs" else F.lit("%")
            row = F.struct(
                part(F.lit(0))["at"].alias("at"), last["to"].alias("to"), F.lit(name).alias("kind"), year.alias("year"), metric.alias("metric_raw"), F.lit(">=").alias("op"),
                _number(last["said"]).alias("value"), unit.alias("unit"), F.lit(basis).alias("basis_kind"), amount.alias("basis_amount"), basis_year.alias("basis_year"),
                F.lit(None).cast("string").alias("tier"),
            )
            out = F.when(got != "", row) if out is None else out.when(got != "", row)
        return out

    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))), lambda i: F.substring(shape, i, 1) == "c")
    return F.filter(F.transform(places, read), lambda x: x.isNotNull())


def matrix_rows(marks: Column, shape: Column) -> Column:
    """Array of rows (at, label, year, cells, heads, decls): table rows of two or more
    percentages, with the tiers and declarations of the characters before them."""

    def read(i: Column) -> Column:
        cells = F.length(F.regexp_extract(F.substring(shape, i, F.length(shape)), "^ly(p{2,})", 1))
        row = F.element_at(marks, i)
        near = F.filter(marks, lambda m: (m["at"] >= row["at"] - HEADER) & (m["at"] < row["at"]))
        code = lambda m: F.regexp_extract(m["said"], "([A-Za-z]+)", 1)
        heads = F.transform(F.filter(near, lambda m: m["kind"] == "t"), lambda m: F.struct(F.regexp_extract(m["said"], _any(TIERS), 0).alias("tier"), code(m).alias("code")))
        known = lambda m: F.regexp_extract(m["said"], f"({_any(OWNERS)}*{_any(HEADS)}{_any(GROWTH)}?)", 1)
        name = lambda m: F.coalesce(F.nullif(known(m), F.lit("")), F.regexp_extract(m["said"], r"^([^\s（(]+)", 1))
        decls = F.transform(F.filter(near, lambda m: m["kind"] == "d"), lambda m: F.struct(name(m).alias("metric"), code(m).alias("code")))
        values = F.transform(F.slice(marks, i + 2, F.greatest(cells, F.lit(1))), lambda m: F.struct(_number(m["said"]).alias("value"), m["to"].alias("to")))
        told = F.struct(row["at"].alias("at"), row["said"].alias("label"), _year(F.element_at(marks, i + 1)["said"]).alias("year"), values.alias("cells"), heads.alias("heads"), decls.alias("decls"))
        return F.when((cells >= 2) & (F.size(heads) + F.size(decls) > 0), told)

    last = F.size(marks) - 3
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (last >= 1) & (F.substring(shape, i, 3) == "lyp"))
    return F.filter(F.transform(places, read), lambda x: x.isNotNull())


def _cells(row: Column) -> Column:
    """One struct for each cell of a matrix row: column j has the j-th tier before the
    row; its metric is the declaration with the tier's code, or with its beginning."""

    def cell(v: Column, j: Column) -> Column:
        head = F.get(row["heads"], j)
        same = F.filter(row["decls"], lambda d: d["code"] == head["code"])
        begins = F.filter(row["decls"], lambda d: head["code"].startswith(d["code"]))
        metric = F.coalesce(F.get(same, F.lit(0))["metric"], F.get(begins, F.lit(0))["metric"])
        return F.struct(row["label"].alias("label"), row["at"].alias("at"), v["to"].alias("to"), row["year"].alias("year"), (j + 1).alias("column"),
                        F.coalesce(head["tier"], F.lit("col")).alias("tier"), F.coalesce(head["code"], (j + 1).cast("string")).alias("code"), metric.alias("metric"), v["value"].alias("value"))

    return F.transform(row["cells"], cell)


def _read(docs: DataFrame, needed: str = f"{STATEMENT}|{ROW}") -> DataFrame:
    """docs with found (statements) and cells (of matrices), marks left out."""
    rows = marked_targets(docs, needed).withColumn("shape", F.array_join(F.transform("marks", lambda m: m["kind"]), ""))
    rows = rows.withColumn("found", statements(F.col("marks"), F.col("shape")))
    return rows.withColumn("cells", F.flatten(F.transform(matrix_rows(F.col("marks"), F.col("shape")), _cells))).drop("marks", "shape")


def _holding(docs: DataFrame, needed: str) -> DataFrame:
    """(doc_id, text) of the texts that hold a pattern: others say nothing that it opens,
    and need not travel to the scanner."""
    return docs.select("doc_id", "text").where(F.col("text").rlike(needed))


def _each(rows: DataFrame, column: str) -> DataFrame:
    """(doc_id, x) of the structs of an array. An inner explode would be given a filter
    on the array's size, for which the array is read twice more."""
    return rows.select("doc_id", F.explode_outer(column).alias("x")).where("x is not null")


def targets(docs: DataFrame) -> DataFrame:
    """(doc_id, at, to, kind, year, metric_raw, op, value, unit, basis_kind, basis_amount,
    basis_year, tier) of each statement in docs(doc_id, text, ..).

    at and to are offsets in characters. Null and empty texts have no statements;
    rows that repeat a document repeat them; an empty table gives no rows."""
    return _each(_read(_holding(docs, STATEMENT), STATEMENT), "found").select("doc_id", "x.*")


def target_matrix(docs: DataFrame) -> DataFrame:
    """(doc_id, label, at, to, year, column, tier, code, metric, value): one row for each cell."""
    return _each(_read(_holding(docs, ROW), ROW), "cells").select("doc_id", "x.*")


def metric_class(raw: Column) -> Column:
    out = None
    for words, name in ALIASES:
        hit = raw.rlike(_any(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def _first_of_each(periods: Column) -> Column:
    """Periods without those that say the same (year, metric, op, value, unit) as one before."""
    same = lambda x, y: (x["year"] == y["year"]) & (x["metric_raw"] == y["metric_raw"]) & (x["op"] == y["op"]) & x["value"].eqNullSafe(y["value"]) & (x["unit"] == y["unit"])
    return F.filter(periods, lambda x, i: ~F.exists(F.slice(periods, F.lit(1), i), lambda y: same(x, y)))


def target_plan(docs: DataFrame) -> DataFrame:
    """docs with what a draft says as a whole: metric, metric_raw, periods, tiers,
    connector, scheme, scheme_source, footnote, share_pay, path, confidence, gap_kind,
    requires_manual. Path is empty where neither way found a target.

    Periods are in order of year and value; the primary metric is the shortest that
    names a net profit, else the shortest, ties by code point."""
    rows = with_scope(_read(docs))
    of_cell = lambda c: F.struct(c["at"], c["to"], F.lit("matrix").alias("kind"), c["year"], F.coalesce(c["metric"], F.lit("")).alias("metric_raw"), F.lit(">=").alias("op"), c["value"], F.lit("%").alias("unit"),
                                 F.lit(None).cast("string").alias("basis_kind"), F.lit(None).cast("double").alias("basis_amount"), F.lit(None).cast("int").alias("basis_year"), c["tier"].alias("tier"))
    rows = rows.withColumn("periods", F.concat("found", F.transform("cells", of_cell)))
    path = F.array_join(F.array_compact(F.array(F.when(F.size("cells") > 0, "matrix"), F.when(F.size("found") > 0, "regex"))), "+")
    raws = F.filter(F.array_distinct(F.transform("periods", lambda p: p["metric_raw"])), lambda r: r != "")
    by = F.sort_array(F.transform(raws, lambda r: F.struct((~r.contains(HEADS[0])).alias("other"), F.length(r).alias("n"), r.alias("raw"))))
    raw = F.coalesce(F.get(by, F.lit(0))["raw"], F.lit(""))
    note = F.regexp_extract(F.coalesce("text", F.lit("")), f"上述[“\"]?(?:{HEADS[0]}|{HEADS[1]})[^。]{{0,400}}。", 0)
    rows = rows.withColumn("path", path).withColumn("metric_raw", raw).withColumn("footnote", note)
    rows = rows.withColumn("periods", F.array_sort(_first_of_each(F.col("periods")), lambda x, y: F.when((x["year"] < y["year"]) | ((x["year"] == y["year"]) & (x["value"] < y["value"])), -1).when((x["year"] == y["year"]) & (x["value"] == y["value"]), 0).otherwise(1)))
    said = F.when(F.col("footnote") != "", F.col("footnote")).otherwise(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("metric", F.when(F.col("metric_raw") == "", "other").otherwise(metric_class(F.col("metric_raw"))))
    rows = rows.withColumn("tiers", F.array_distinct(F.transform("cells", lambda c: F.struct(c["tier"].alias("tier"), c["code"].alias("code"), c["metric"].alias("metric")))))
    rows = rows.withColumn("connector", F.when(F.coalesce("text", F.lit("")).rlike(_any(EITHER)), "or").otherwise("and"))
    rows = rows.withColumn("share_pay", said.rlike("剔除[^。]{0,60}股份支付|股份支付费用"))
    rows = rows.withColumn("confidence", F.when(F.col("path") == "regex", "high").when(F.col("path") != "", "medium"))
    rows = rows.withColumn("gap_kind", F.when(F.col("share_pay"), "interval").otherwise("point"))
    return rows.withColumn("requires_manual", F.col("metric").isin(*UNCLEAR)).drop("found", "cells")


def target_dedupe(docs: DataFrame) -> DataFrame:
    """(doc_id, the columns of a period, primary metric and its class): each target of a document once."""
    rows = target_plan(docs.select("doc_id", "text")).select("doc_id", F.col("metric_raw").alias("primary_raw"), F.col("metric").alias("primary"), F.explode_outer("periods").alias("x")).where("x is not null")  # as _each
    return rows.select("doc_id", "x.*", "primary_raw", "primary", metric_class(F.col("x.metric_raw")).alias("metric"))


def with_scope(docs: DataFrame) -> DataFrame:
    """docs with scheme (subsidiary or company) and scheme_source (default, explicit,
    heuristic). Each anchor votes by a level word that ends before it and starts in
    the 80 characters before; without one, by a held subsidiary's target in the 400
    before; a tie is the company's."""

    def scan():
        ahead = lambda p: re.compile(f"(?=({p}))")
        kinds = [("anchor", re.compile(ANCHOR)), ("sub", ahead(_any(SUBSIDIARY))), ("main", ahead(_any(COMPANY))), ("held", ahead(f"{HELD}[^。]{{0,20}}?(?:{ANCHOR}|{SHORT_ANCHOR})"))]
        return lambda text: _scan_kinds(kinds, text)

    marks = F.col("levels")
    held_before = lambda a, kind, width: F.exists(marks, lambda m: (m["kind"] == kind) & (m["at"] >= a["at"] - width) & (m["to"] <= a["at"]))
    vote = lambda a: F.when(held_before(a, "sub", TIGHT), "sub").when(held_before(a, "main", TIGHT), "main").when(held_before(a, "held", WIDE), "guess").otherwise("main")
    votes = F.transform(F.filter(marks, lambda m: m["kind"] == "anchor"), vote)
    rows = _marked(docs, "levels", scan).withColumn("votes", votes)
    sub, guess = F.size(F.filter("votes", lambda v: v != "main")), F.exists("votes", lambda v: v == "guess")
    below = sub > F.size("votes") - sub
    source = F.when(F.size("votes") == 0, "default").when(below & guess, "heuristic").otherwise("explicit")
    return rows.withColumn("scheme", F.when(below, "subsidiary").otherwise("company")).withColumn("scheme_source", source).drop("levels", "votes")


def coverage(plans: DataFrame) -> DataFrame:
    """(group, name, total, extracted, rate): of all plans, by path and by metric."""
    hit = F.col("path") != ""
    rows = plans.select(F.when(hit, F.col("path")).alias("path"), F.when(hit, F.col("metric")).alias("metric"), hit.alias("hit"))
    sets = rows.groupingSets([["path"], ["metric"], []], "path", "metric").agg(F.count("*").alias("total"), F.count_if("hit").alias("extracted"), F.grouping("path").alias("p"), F.grouping("metric").alias("m"))
    group = F.when((F.col("p") == 1) & (F.col("m") == 1), "all").when(F.col("p") == 0, "path").otherwise("metric")
    named = F.when(group == "all", "").otherwise(F.coalesce("path", "metric", F.lit("none")))
    return sets.select(group.alias("group"), named.alias("name"), "total", "extracted", F.round(F.col("extracted") / F.col("total"), 4).alias("rate"))


def misses(plans: DataFrame, link: str) -> DataFrame:
    """(doc_id, code, link, reason) of the plans without a target: the list to read by hand."""
    anchored = F.coalesce(F.col("text").contains(ANCHOR) | F.col("text").contains("如下表所示"), F.lit(False))
    return plans.where("path = ''").select("doc_id", "code", F.col(link).alias("link"), F.when(anchored, "no pattern found").otherwise("no anchor").alias("reason"))


def graded(docs: DataFrame, source: str | None = None) -> DataFrame:
    """docs(.., text) with level, stage, terms (struct<at, said>), realised, sentence.

    Spans that a negation opens (its words and 12 characters more, up to a stop) are
    taken off the stage words' spans; 批量 does not count after 小. The level is the
    highest left; terms are its words by offset, the sentence 45 characters to either
    side of the first. Where `source` names a column, questions are left out."""
    docs = docs if source is None else docs.where(F.coalesce(F.col(source) != QUESTION, F.lit(True)))

    def scan():
        kinds = [("n", re.compile(f"{_any(NEGATIONS)}[^。；;，,]{{0,12}}"))]
        for level, words in enumerate(STAGE_WORDS, 1):
            kinds.append((str(level), re.compile("|".join(f"(?<!小){re.escape(w)}" if w.startswith("批量") else re.escape(w) for w in words))))
        return lambda text: _scan_kinds(kinds, text)

    rows = _marked(docs, "spans", scan)
    negated = lambda m: F.exists(F.col("spans"), lambda n: (n["kind"] == "n") & (n["at"] < m["to"]) & (m["at"] < n["to"]))
    rows = rows.withColumn("spans", F.filter("spans", lambda m: (m["kind"] != "n") & ~negated(m)))
    rows = rows.withColumn("level", F.coalesce(F.array_max(F.transform("spans", lambda m: m["kind"].cast("int"))), F.lit(0)))
    rows = rows.withColumn("terms", F.transform(F.filter("spans", lambda m: m["kind"].cast("int") == F.col("level")), lambda m: F.struct(m["at"], m["said"])))
    at = F.get("terms", F.lit(0))["at"]
    low = F.greatest(at - 45, F.lit(0))
    said = F.when(F.size("terms") > 0, F.substring(F.col("text"), low + 1, at + 45 - low)).otherwise("")
    names = F.array(F.lit("unknown"), *[F.lit(s) for s in STAGES])
    rows = rows.withColumn("stage", F.element_at(names, F.col("level") + 1)).withColumn("realised", F.col("level") >= REALISED)
    return rows.withColumn("sentence", said).drop("spans")


def evidence(records: DataFrame) -> DataFrame:
    """(code, n, rank, latest, date, level, ..): every graded record of a code with a
    stage, in order of date, level and doc_id; null dates first. The last is the
    code's stage now. records(code, source, date, doc_id, text, ..)."""
    rows = graded(records, "source").where("level > 0")
    order = Window.partitionBy("code").orderBy(F.col("date").asc_nulls_first(), "level", "doc_id")
    counts = rows.groupBy(F.col("code").alias("own")).agg(F.count("*").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.join(counts, F.col("code").eqNullSafe(F.col("own"))).drop("own").withColumn("latest", F.col("rank") == F.col("n"))
