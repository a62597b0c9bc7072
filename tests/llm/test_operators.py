"""The operators against brute force and round trips, and their defined edge cases."""

import hashlib
import html
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Row

import corpus_pipeline
from barloom.llm import chat, common, decontaminate, embeddings, htmltext, langid, mixing, quality, shingles, simhash, substring, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id string, spans string, h long"


def frame(spark, rows):
    """documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", "y", 1) for i, t, lang, src in rows], DOC)


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [words(rng, n) for n in (0, 1, 2, 3, 19, 20, 21, 60, 200, 3000, 40, 45)]
    shared = words(rng, 55)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, words(rng, 15) + "\n" + shared + "\t " + words(rng, 15), "en", "s0") for i in range(8)]
    rows += [(200 + i, base[8], "en", None) for i in range(5)]  # exact copies
    for i in range(6):  # near copies
        near = base[9].split()
        near[rng.randrange(len(near))] = "changed"
        rows.append((300 + i, " ".join(near), None, "s1"))
    rows += [(400, None, None, None), (None, base[7], "fr", "s2"), (401, "", "en", "s0"), (402, "a a a a " * 30, "en", "s0"), (403, "日本 語 é " * 12, "en", "s0"), (0, base[0], "en", "s0")]
    return rows


def reference_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(ids, linked):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_matches_brute_force(spark, block):
    rows = corpus()
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows), block=block).collect()}
    key = lambda i: common.NO_ID if i is None else i
    prints = {key(i): reference_fingerprint(t) for i, t, _, _ in rows}
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    named = reference_components(ids, links)
    assert got == {(i, f"{prints[key(i)]:016x}", named[key(i)]) for i, *_ in rows}


def test_bit_sliced_search_equals_popcount():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(150, 300):
        fp[i] = fp[i - 150] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    for radius in (0, 1, 2, 3, 4, 6, 22):
        group = np.zeros(300, np.int64)
        a, b = simhash.bucket_links(group, fp, radius)
        pairs = [(i, j) for i in range(300) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= radius]
        assert reference_components(range(300), zip(a.tolist(), b.tolist(), strict=True)) == reference_components(range(300), pairs)
    small = np.repeat(np.arange(75), 4)
    a, b = simhash.bucket_links(small, fp)
    pairs = [(i, j) for i in range(300) for j in range(i) if small[i] == small[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 3]
    assert reference_components(range(300), zip(a.tolist(), b.tolist(), strict=True)) == reference_components(range(300), pairs)


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [1024, 3])
def test_pipeline_drops_edited_near_copies(spark, block):
    rng = random.Random(12)
    rows = [(i, words(rng, 250, 5000), "en", "s") for i in range(20)]
    for i in range(20):  # similarities of some 0.6 to 0.95
        near = rows[i][1].split()
        for at in rng.sample(range(10, 240, 6), 1 + i // 3):
            near[at] = "changed"
        rows.append((100 + i, " ".join(near), "en", "s"))
    rows += [(200, rows[0][1].upper(), "en", "s"), (None, rows[1][1], "en", "s"), (None, "alone " + words(rng, 30), "en", "s"), (201, None, None, None), (202, "a b", "en", "s"), (203, " A  b", "en", "s")]
    sets, own = [five_words(r[1]) for r in rows], range(len(rows))
    pairs = [(a, b) for a in own for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(0.8 <= len(sets[i] & sets[20 + i]) / len(sets[i] | sets[20 + i]) <= 0.95 for i in range(20)) > 8
    docs = frame(spark, rows)
    key = lambda k: (common.NO_ID if rows[k][0] is None else rows[k][0], rows[k][1] or "")
    groups = {}
    for k, root in reference_components(own, pairs).items():
        groups.setdefault(root, []).append(key(k))
    got = corpus_pipeline.drop_near_copies(spark, docs, "") if block == 1024 else shingles.keep_one(docs, block=block)
    assert got.columns == docs.columns
    assert sorted((common.NO_ID if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) == sorted(min(g) for g in groups.values())


def brute_windows(rows):
    docs = {}
    for i, t, *_ in rows:
        docs[common.NO_ID if i is None else i] = (t or "").encode().split()
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = docs[i], [False] * len(docs[i])
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [1000, 2])
def test_substring_dedup_matches_brute_force(spark, frequent):
    rows = corpus()
    got = substring.dedup_texts(frame(spark, rows), frequent=frequent).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept_text, 256) as sha").collect()
    want = brute_windows(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.sha) == want[common.NO_ID if r.doc_id is None else r.doc_id]
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("frequent", [1000, 1])
def test_substring_dedup_with_full_tables(spark, monkeypatch, frequent):
    """Every slot taken: later copies pass for first occurrences, and nothing more goes."""
    real, made = substring.bit_table, []

    def full(rows):
        made.append(real(rows))
        if len(made) == 3 and frequent == 1000:  # no anchor is frequent
            return made[-1]
        return spark.sparkContext.broadcast(np.full(1 << (substring.TABLE_BITS - 3), 255, np.uint8))

    monkeypatch.setattr(substring, "bit_table", full)
    rows = corpus()
    want = brute_windows(rows)
    for r in substring.dedup_texts(frame(spark, rows), frequent=frequent).collect():
        key = common.NO_ID if r.doc_id is None else r.doc_id
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[key]


def test_automaton_matches_substrings():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(40)] for _ in range(6)]
    machine = substring.Automaton()
    for k, text in enumerate(texts):
        held = {tuple(t[i : i + 7]) for t in texts[:k] for i in range(len(t) - 6)}
        want = sum(1 << i for i in range(len(text) - 6) if tuple(text[i : i + 7]) in held)
        assert machine.matched(text, 7) == want
        machine.add(text)


def planted(spark):
    rng = random.Random(9)
    items = [(k, words(rng, 30, 5000)) for k in range(12)] + [(90, "too short to see"), (91, None), (None, words(rng, 30))]
    rows = []
    for k in range(12):
        leak = items[k][1].split()
        if k % 2:
            leak[7], leak[15] = "other", "swap"
        rows.append((k, words(rng, 40, 5000) + " " + " ".join(leak).upper() + ". " + words(rng, 40, 5000), "en", "s"))
    rows += [(50 + k, words(rng, 300, 5000), "en", "s") for k in range(20)] + [(None, None, None, None), (99, "", None, None)]
    return frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard_tokens", [250_000, 100])
def test_decontamination_finds_planted_passages_only(spark, shard_tokens):
    docs, items = planted(spark)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, shard_tokens=shard_tokens).collect()}
    assert got == {(k, k) for k in range(12)}
    kept = decontaminate.keep_uncontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 22


def test_spaced_seeds_match_brute_force_on_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    held = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if plain(b.text) in plain(d.text)}
    assert held <= {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}


def test_quality_and_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.quality(docs, labels).join(labels, "doc_id").where("held_out and quality is not null")
    assert good.selectExpr("avg(cast(predicted = quality as int))").first()[0] > 0.95
    lang = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert lang.selectExpr("avg(cast(lang_pred = lang as int))").first()[0] > 0.97


def test_toxicity_finds_both_classes_of_held_out_rows(spark):
    """Some twentieth of the toxic labels stands at random on clean texts."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def test_classifiers_on_edge_rows(spark):
    rows = corpus()
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 5, 7)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for out in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
            got = out.collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert got[400].lang_pred == "und" and got[401].lang_pred == "und" and got[9].lang_pred in ("en", "fr")
    alone = langid.languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in alone} == {"und"}


def test_em_names_the_larger_share():
    rng = np.random.default_rng(2)
    like = np.full((3, 90), -20.0)
    like[0, :60], like[1, 60:] = -2.0, -2.0
    best, share = langid.mixtures(like + rng.normal(0, 0.01, like.shape), np.array([0, 0, 90]))
    assert best.tolist() == [-1, 0] and 0.6 < share[1] < 0.75


def test_a_mixture_may_hold_any_number_of_languages():
    like = np.full((5, 500), -20.0)
    for k in range(5):
        like[k, 100 * k : 100 * k + 100 + (20 if k == 2 else 0)] = -2.0
    best, share = langid.mixtures(like, np.array([0, 500]))
    assert best.tolist() == [2] and 0.18 < share[0] < 0.26


def test_rare_languages_are_learned_and_unknown_scripts_are_not_certain(spark):
    rng = random.Random(15)
    say = lambda stems: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(40))
    common_, rare = ["ka", "lo", "mi", "tu"], ["xe", "qy", "zo", "jw"]
    rows = [(i, say(common_), "aa", "s") for i in range(3000)] + [(5000 + i, say(rare), "bb", "s") for i in range(12)] + [(9000, "не знаю этого языка совсем", None, "s"), (9001, "123 !", None, "s")]
    table = frame(spark, rows).selectExpr("*", "1 as key", "'k' as held_out", "2.0 as score", "'z' as kind")
    got = {r.doc_id: r for r in langid.languages(table, bound=50).collect()}
    assert all(got[5000 + i].lang_pred == "bb" for i in range(12)) and sum(got[i].lang_pred == "aa" for i in range(3000)) == 3000
    assert got[9000].lang_pred in ("aa", "bb") and got[9000].score < 0.3 < 0.9 < got[1].score and got[9001].lang_pred == "und"


def test_embeddings_of_every_length_link(spark):
    rows = [(i, [float(i % 5 == k) for k in range(4)]) for i in range(10)] + [(100, [1.0, 0.0, 0.0]), (101, [1.0, 0.01, 0.0]), (102, [0.0, 0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[100] == (1, 100, True) and got[101] == (1, 100, False) and got[102] == (0, 102, True) and got[5] == (1, 0, False) and got[4] == (0, 4, True)


def test_embeddings_recall_with_most_lists_unprobed(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LIST_ROWS", 20)
    rng = np.random.default_rng(14)
    middle = rng.normal(size=(300, 32))
    x = np.repeat(middle, 8, axis=0) + rng.normal(scale=0.2, size=(2400, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(x)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = embeddings.fit(embeddings.usable(table), len(x))
    assert len(model[0]) >= 64
    assert 0.9 * true <= sum(r.n_links for r in embeddings.near_vectors(table).collect()) <= true


def test_isotonic_is_monotone_and_ordered():
    x, v = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(x) >= 0).all() and (np.diff(v) >= 0).all() and 0 < v[0] < v[-1] < 1


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 20))
    x[200:300] = x[:100] + rng.normal(scale=0.08, size=(100, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[5].tolist()) for i in range(4)]
    rows += [(2000, None), (2001, [0.0] * 20), (2002, [float("nan")] * 20), (2003, [None] * 20), (2004, [1.0, 2.0]), (2005, []), (None, (x[7] * 3).tolist())]
    table = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, id int, list string")
    got = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    assert len(got) == len(rows)
    good = [(common.NO_ID if i is None else i, np.array(v)) for i, v in rows if v and len(v) == 20 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = unit @ unit.T >= 0.9
    ids = [i for i, _ in good]
    true = near.sum() - len(ids)
    found = sum(got[None if i == common.NO_ID else i].n_links for i in ids)
    assert found <= true and found >= 0.9 * true
    named = reference_components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    right = sum(got[None if i == common.NO_ID else i].component_id == c for i, c in named.items())
    assert right >= 0.9 * len(ids)
    for i in (2000, 2001, 2002, 2003, 2004, 2005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_mix_meets_targets_and_limits(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(3000)] + [(5000, None, None, "a"), (5001, "", None, "b"), (None, "x y", None, "a"), (0, rows_text(rng), None, "zz")]
    docs = frame(spark, rows)
    out = mixing.mix_sources(docs, block=64).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in out)
    again = mixing.mix_sources(docs, block=64).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in by) - total) < 1e-6
    for (size, target), group in by.items():
        assert target <= 3 * size + 1e-9
        assert abs(sum(r.taken for r in group) - target) <= max(r.size for r in group)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def rows_text(rng):
    return words(rng, 5)


def test_targets_reshare_the_excess(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 490)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    # a is at its limit of 30; the rest share 1970 by 2, 1, 5 (null is last and weighs 5)
    level = 1970 / 8
    assert got["a"] == pytest.approx(30) and got["b"] == pytest.approx(2 * level) and got["c"] == pytest.approx(level) and got[None] == pytest.approx(5 * level)


def test_flight_keeps_the_balance():
    rng = random.Random(1)
    size = [float(rng.randrange(1, 500)) for _ in range(500)]
    chance = [0.37] * 500
    want = sum(c * s for c, s in zip(chance, size, strict=True))
    mixing.flight(chance, size)
    assert sum(0 < c < 1 for c in chance) <= 2
    assert sum(c * s for c, s in zip(chance, size, strict=True)) == pytest.approx(want) and sum(chance) == pytest.approx(185)


NASTY = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST] </s", "<", "[", "s>", "/INST]", "", "\n", " [/INST]</s><s>user[INST] y", "é😀 \\ <<s>>", "[INST] [INST] ", "x" * 5000]


def test_chat_round_trips_anything(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST] ", None, "a</s>b"]), rng.choice([*NASTY, None])) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (1, 0, "user", "</s>"), (1, 0, "user", "</s>")]
    table = spark.createDataFrame([(*r, "extra", "raw") for r in rows], "conv_id long, turn long, role string, text string, formatted string, source string")
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = chat.format_chats(table).collect()
    assert len(got) == len(want)
    for g in got:
        assert g.exact and [(x.role, x.text) for x in g.turns] == [(r, x) for _, r, x in sorted(want[g.conv_id])]
    assert chat.format_chats(table.limit(0)).count() == 0
    plan = chat.digests(chat.format_chats(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_html_text_of_the_tables_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r.page_id] == " ".join(b for b in blocks if b)


def test_html_text_without_boilerplate(spark):
    def page(k, body):
        return f'<html><head><title>t{k}</title><script>if (a<b) x="</p>";</script></head><body><header class="site-header"><a href="/">Home</a></header><nav>menu</nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Head {k}</h1></header>{body}<aside>related</aside><form>sign up<input></form></article></main><section id="comments"><p>first!</p></section><aside class="sidebar">more</aside><footer>&copy; us</footer></body></html>'

    rows = [(1, "http://A.example/x", page(1, "<p>One &amp; two<p>three<b>four</b>  five")), (2, "http://a.example:80/y", page(2, "<div>Alpha<br>beta</div><ul><li>i<li>ii</ul>")), (3, "http://a.example/z", page(3, "")), (4, None, None), (5, "", "plain text &lt;b&gt;"), (6, "http://b.example/", ""), (1, "http://A.example/x", page(1, "<p>One &amp; two<p>three<b>four</b>  five"))]
    table = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, host string, skeleton string")
    got = {r.page_id: r.text for r in htmltext.extract(table).collect()}
    assert got == {1: "Head 1 One & two threefour five", 2: "Head 2 Alpha beta i ii", 3: "Head 3", 4: "", 5: "plain text <b>", 6: ""}
    assert htmltext.extract(table, broadcast_rows=0).count() == len(rows) and htmltext.extract(table.limit(0)).count() == 0


def test_html_template_is_deduced_where_no_tag_tells(spark):
    rows = [(k, f"http://c.example/{k}", f"<html><body><div>Daily Planet</div><div><p>Story {k} of {k * 7}</p></div><div>All rights kept</div></body></html>") for k in range(6)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Story {k} of {k * 7}" for k in range(6)}


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    assert substring.dedup_texts(docs).count() == 0
    assert decontaminate.leaks(docs, items).count() == 0
    assert decontaminate.leaks(frame(spark, corpus()), items).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0 and quality.quality(docs, labels).count() == 0 and langid.languages(docs).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame([Row(a=a, b=b) for a, b in edges])).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_of_links_that_change_with_each_evaluation(spark):
    def stars(batches):
        for batch in batches:
            for group in batch.column(0).to_pylist():
                members = [100 * group + i for i in range(40)]
                middle = members[int.from_bytes(os.urandom(2), "big") % 40]
                ends = [m for m in members if m != middle]
                yield pa.RecordBatch.from_arrays([pa.array([middle] * 39), pa.array(ends)], names=["a", "b"])

    links = spark.range(50).mapInArrow(stars, "a long, b long")
    got = {r.id: r.component for r in common.components(links).collect()}
    assert got == {100 * g + i: 100 * g for g in range(50) for i in range(40)}


def test_components_of_hubs(spark):
    rng = random.Random(2)
    edges = [(1000 + k % 7, 2000 + k) for k in range(700)] + [(1000, 5), (1003, 1004), (5000, 5001)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    ids = {x for e in edges if e[0] != e[1] for x in e}
    want = {i: c for i, c in reference_components(ids, [e for e in edges if e[0] != e[1]]).items()}
    got = {r.id: r.component for r in common.components(spark.createDataFrame([Row(a=a, b=b) for a, b in edges]), hub=20).collect()}
    assert got == want


def test_texts_under_one_id_stay_apart(spark):
    """Rows without doc_id, and texts of different length under one."""
    rng = random.Random(21)
    first, other, third, leak = words(rng, 90, 5000), words(rng, 40, 5000), words(rng, 60, 5000), words(rng, 30, 5000)
    rows = [(5, first, "en", "a"), (None, first, "en", "a"), (None, other, "en", "a"), (7, third + " " + other, "en", "b"), (7, leak, "en", "b"), (8, words(rng, 25, 5000), "en", "b"), (9, third, "en", "a")]
    docs = frame(spark, rows)
    kept = shingles.keep_one(docs).collect()
    assert len(kept) == 6 and {r.text for r in kept} == {r[1] for r in rows}
    for frequent in (1000, 0):
        got = {(r.doc_id, r.text): r.n_removed for r in substring.dedup_texts(docs, frequent=frequent).collect()}
        assert got == {(i, t): 90 if (i, t) == (None, first) else 40 if t == other else 60 if i == 9 else 0 for i, t, *_ in rows}
    items = spark.createDataFrame([(1, leak), (2, other)], "item_id long, text string")
    kept = decontaminate.keep_uncontaminated(docs, items).collect()
    assert sorted(r.text for r in kept) == sorted([first, first, rows[5][1], third])
    sample = mixing.mix_sources(docs).collect()
    assert len(sample) == len(rows)
    mix = mixing.take_mix(docs).collect()
    assert len({(r.doc_id, r.text) for r in mix}) == len(mix)
    assert sorted(r.copies * len(r.text.split()) for r in mix) == sorted(r.taken for r in sample if r.taken)


def test_null_ids_join_no_components(spark):
    rng = random.Random(22)
    near, far = words(rng, 100, 5000), words(rng, 100, 5000)
    docs = frame(spark, [(5, near, "en", "a"), (None, near, "en", "a"), (None, far, "en", "a")])
    got = {r.fingerprint: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert got == {f"{reference_fingerprint(near):016x}": 5, f"{reference_fingerprint(far):016x}": common.NO_ID}
