"""HTML main text: the deduced template decides, whatever elements and classes are called."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import htmltext


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    return " ".join(b for b in blocks if b)


def scrambled(how):
    text = F.regexp_replace("html", 'class="ad"', 'class="zq"')
    text = F.regexp_replace(F.regexp_replace(text, "<article>", '<div class="k7">' if how == "renamed" else ""), "</article>", "</div>" if how == "renamed" else "")
    return F.regexp_replace(F.regexp_replace(text, "<(/?)nav>", "<$1div>"), "<(/?)footer>", "<$1section>").alias("html")


@pytest.mark.parametrize("how", ["renamed", "stripped"])
def test_slots_decide_where_names_say_nothing(spark, how):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    told = pages.select("page_id", "url", scrambled(how))
    got = {r.page_id: r.text for r in htmltext.extract(told).collect()}
    assert sum(got[k] == v for k, v in want.items()) >= 0.95 * len(want)
    empty = htmltext.Template([])
    bare = {r.page_id: htmltext.main_text(r.html, empty) for r in told.limit(200).collect()}
    assert all(bare[k] != want[k] for k in bare)


def shop(k, html_class="body"):
    said = " ".join(f"w{k}x{i}" for i in range(40))
    return f'<html><body><div class="a1">Menu {k}</div><div class="{html_class}"><h1>Head {k}</h1><p>{said}</p><ul class="q"><li>Tell your friends</li></ul><p>Written for the Daily</p></div><div class="z9">Also read {k + 1}</div></body></html>'


def extracted(spark, pages):
    rows = [(k, f"http://host.example/{k}", p) for k, p in enumerate(pages)]
    return [r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_constant_containers_inside_the_article_go_and_constant_lines_stay(spark):
    got = extracted(spark, [shop(k) for k in range(12)])
    assert got == [f"Head {k} " + " ".join(f"w{k}x{i}" for i in range(40)) + " Written for the Daily" for k in range(12)]


@pytest.mark.parametrize("n", [1, 4, 12])
def test_constant_words_in_the_article_stay(spark, n):
    said = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(n)]
    page = "<html><body><nav>Home</nav><article><p>{} by <b>Name</b>.</p><h2>Introduction</h2><p>It costs <b>3</b> dollars and <i>m3</i>, more.</p></article><footer>Imprint</footer></body></html>"
    assert extracted(spark, [page.format(x) for x in said]) == [f"{x} by Name. Introduction It costs 3 dollars and m3, more." for x in said]


@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("n", [1, 12])
def test_the_article_comes_before_longer_comments(spark, n, inside):
    said = [" ".join(f"w{k}x{i}" for i in range(50)) for k in range(n)]
    told = [" ".join(f"c{k}x{i}" for i in range(200)) for k in range(n)]
    around = ("<main>", "", "</main>") if inside else ("", "", "")
    pages = [f'<html><body>{around[0]}<article><h1>T{k}</h1><p>{said[k]}</p></article><div class="thread"><p>{told[k]}</p></div>{around[2]}</body></html>' for k in range(n)]
    assert extracted(spark, pages) == [f"T{k} {said[k]}" for k in range(n)]


def test_inline_notes_on_every_page_stay(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    noted = pages.withColumn("html", F.regexp_replace("html", "</p>", " <i>see note</i>.</p>"))
    got = {r.page_id: r.text for r in htmltext.extract(noted).collect()}
    assert all(got[k].replace(" see note.", "") == v for k, v in plain.items())
    assert sum(" see note." in x for x in got.values()) > 200  # the others close no paragraph


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<div>" * 100_000 + "x", "<div>x" * 50_000 + "</section>" * 50_000, "<p '" + "<b \"" * 200_000, "<" * 1_000_000, "<!" * 300_000], ids=str.__len__)
def test_broken_markup_takes_linear_time(page):
    began = time.process_time()
    template = htmltext.Template([])
    htmltext.main_text(page, template)
    told = htmltext.tokens(page)
    rows = [{"token": t, "parent": r[2], "flags": r[3], "chars": r[4], "place": float(r[1]), "skeleton": r[0] == 1, "often": bool(r[3] & htmltext.OPENS)} for t, r in told.items()]
    htmltext.main_text(page, htmltext.Template(rows))
    assert time.process_time() - began < 15


def test_copies_of_one_page_are_no_template(spark):
    rows = [(k, f"http://copy.example/{k}", shop(3)) for k in range(12)]
    got = {r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and got.pop().endswith("w3x39 Written for the Daily")


def test_a_hot_host_meets_its_template_by_salt(spark):
    rows = [(k, f"http://hot.example/{k}", shop(k)) for k in range(40)] + [(None, None, None), (90, "", ""), (91, "http://x.example", "<p>" + "long " * 200_000)]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, template string, salt int")
    by = {n: sorted((r.page_id or -1, r.text) for r in htmltext.extract(table, broadcast_rows=n).collect()) for n in (0, 1000)}
    assert by[0] == by[1000] and len(by[0]) == 43 and len(dict(by[0])[91]) == 999_999
