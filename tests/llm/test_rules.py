"""Quality rules: counts against plain loops and SQL, the order of the cascade, edge rows."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from barloom.llm import rules

KIND = "doc_id long, text string, n_words long, failed string, row string, text2 string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = [" ".join(word() for _ in range(n)) for n in (0, 1, 7, 8, 9, 19, 20, 21, 60, 400)]
    part = " ".join(word() for _ in range(30))
    return [
        None, "", " \t\n\x0b\x0c\r", *prose, f"{part}\n{prose[8]}\n{part}", f"{part} {part} {part}", "a " * 50, "日本 語 " * 30,
        "# $ % & | < > * " * 9, "\n".join(["same line here"] * 30), f"x\n{part}\n\n \n{part}\n", "w" * 500_000, "one two " * 60_000, "　nbsp  word " * 30,
    ]


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n, chars, symbols, dup, again = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    base = n < 20 or 100 * again > 30 * n
    kept = not (base or 10 * symbols > n or not 2 * n <= chars <= 12 * n or 100 * dup > 35 * len(lines))
    return n, chars, symbols, dup, again, base, kept


def documents(spark, sf_dir):
    rows = [(i, t, 5, "f", "r", "x") for i, t in enumerate(texts())]
    rows += [(None, rows[10][1], 0, None, None, None), (3, rows[3][1], 0, "", "", ""), (3, rows[3][1], 0, "", "", "")]
    spark.createDataFrame(rows, KIND).write.parquet(f"{sf_dir}/documents.parquet")
    return rows


def test_counts_and_verdicts(spark, tmp_path):
    rows = documents(spark, str(tmp_path))
    got = rules.op12(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == sorted(((r[0], *counted(r[1])) for r in rows), key=str)


def test_any_order_keeps_the_same_documents(spark, tmp_path):
    rows = documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows if counted(r[1])[-1])
    for order in (list(rules.RULES), list(rules.RULES)[::-1], None):
        kept = rules.keep_passing(docs, order=order)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()) == want


def test_no_statistic_behind_the_rule_that_rejects(spark):
    docs = spark.createDataFrame([(1, "too few", 0, "", "", "")], KIND)
    told = rules.judge(docs, order=list(rules.RULES)).first()
    assert told.failed == "few_words" and told.n_words == 2
    assert told.n_repeat_words is None and told.hashes is None and told.n_symbols is None
    assert "Python" not in rules.judge(docs, order=list(rules.RULES))._jdf.queryExecution().toString()


def test_order_is_by_rejection_per_cost():
    a, b, c = (rules.Rule(n, (n,), lambda s: F.lit(True)) for n in "abc")
    patterns = [(frozenset("a"), 50), (frozenset("ab"), 10), (frozenset("c"), 20), (frozenset(), 20)]
    by = lambda costs: [r.name for r in rules.order_rules(costs, patterns, (a, b, c))]
    assert by({"a": 1.0, "b": 1.0, "c": 1.0}) == ["a", "c", "b"]
    assert by({"a": 60.0, "b": 1.0, "c": 10.0}) == ["b", "c", "a"]  # what b rejects is not counted for a again
    assert by({"a": 1000.0, "b": 1000.0, "c": 0.5}) == ["c", "a", "b"]


def test_empty_table(spark):
    assert rules.judge(spark.createDataFrame([], KIND)).isEmpty()


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = duck.sql(rules.OP12_SQL)
    got = rules.op12(spark, "/root/testdata/sf0.001").select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_clean_documents_stay(spark):
    told = rules.op12(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in told.groupBy("quality", "kept").count().collect()}
    assert by[1, True] >= 0.95 * (by[1, True] + by.get((1, False), 0)) and by[0, False] >= 0.9 * (by[0, False] + by.get((0, True), 0))
