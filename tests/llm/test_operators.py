"""Operators against brute force, with nulls, empty tables, ties, repeated rows and clashing columns."""

import html
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thawline.llm import common, components, decontam, htmltext, jaccard, knn, labelled_pages, mixing, queries, suffixes, toxicity

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice("abcdé") + str(int(rng.random() ** 2 * vocabulary)) for _ in range(n))


def near_copy(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def documents(rng):
    base = [prose(rng, n) for n in (120, 200, 60, 300, 90)]
    passage = prose(rng, 70)
    texts = [None, "", " \n", "One two three", "one TWO three", "word", "a b c d e", "a b c d e"]
    texts += [x for b in base for x in (b, b.upper(), near_copy(rng, b, 1), near_copy(rng, b, 2), near_copy(rng, b, 5))]
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30 * i)}" for i in range(4)]
    texts += [near_copy(rng, base[0], 3) for _ in range(25)] + ["same " * 3000, f"x {'same ' * 3000}"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = documents(random.Random(8))
    rows = [(i * 7 % 1009, t, "sig") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame([*rows, (None, texts[8], "sig"), (None, "alone here", "sig"), rows[9]], "doc_id long, text string, sig string")


def shingles(text):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(spark, docs, monkeypatch):
    rows, frame = docs
    sets = {d: shingles(t) for d, t, _ in rows}
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    plain = jaccard._signature
    for run_rows, bits in ((1000, -1), (3, -1), (1000, 7)):
        monkeypatch.setattr(jaccard, "RUN_ROWS", run_rows)
        # of few bits: unlike sets share their first number
        monkeypatch.setattr(jaccard, "_signature", lambda g, o, seed, bits=bits: plain(g, o, seed) & (bits if seed == 0xA5A5A5A5A5A5A5A5 else -1))
        got = jaccard.jaccard_components(frame).toPandas()
        assert len(got) == len(rows) + 3
        known = got.dropna(subset=["doc_id"]).drop_duplicates()
        assert {int(r.doc_id): (r.n_shingles, int(r.component_id)) for r in known.itertuples()} == {d: (len(s), root(d)) for d, s in sets.items()}
        lost = got[got.doc_id.isna()].component_id.fillna(-1).tolist()
        assert sorted(lost) == [-1, root(rows[8][0])]
    assert jaccard.jaccard_components(frame.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).toPandas()
    assert dict(zip(got.node, got.component)) == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}


def test_sketch_counts_every_shingle(spark, docs):
    rows, frame = docs
    counts = jaccard.sketch(jaccard.describe(frame.select("doc_id", "text").repartition(3), 5))
    assert int(counts.sum()) == sum(len(shingles(t)) for _, t, _ in rows) + len(shingles(rows[8][1])) + len(shingles("alone here")) + len(shingles(rows[9][1]))


def test_repeated_passages(spark, docs):
    rows, frame = docs
    where = {}
    words = {d: ALNUM.findall(lower(t)) for d, t, _ in rows}
    for d, w in words.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(d)
    expect = set()
    for d, w in words.items():
        starts = [i for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1]
        spans = []
        for i in starts:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + 50
                spans[-1][2] = min(spans[-1][2], *where[tuple(w[i : i + 50])])
            else:
                spans.append([i, i + 50, min(where[tuple(w[i : i + 50])])])
        expect |= {(d, a, b, b - a, f) for a, b, f in spans}
    got = {tuple(r) for r in suffixes.repeated_passages(frame).collect()}
    assert got == expect and expect
    assert suffixes.repeated_passages(frame.where("false")).count() == 0


def test_repeated_passages_leave_one_table(spark, docs):
    with common.noting(noted := []):
        got = suffixes.repeated_passages(docs[1])
    assert [path.split("/")[-1] for path in noted] == ["kept"]
    folder = os.path.dirname(os.path.dirname(noted[0].removeprefix("file:")))
    left = [x for x in os.listdir(folder) for x in os.listdir(f"{folder}/{x}")]
    assert not {"suffixes", "repeats", "stretches", "shared"} & set(left) and got.count() > 0


@pytest.mark.parametrize("clash", [False, True])
def test_shared_stretches_of_one_number(spark, clash):
    rows = [(1, 10, 5, 0), (1, 10, 3, 7), (1, 10, 3, 9), (2, 20, 4, 0), (2, 20, 4, 1), (3, 30, 8, 2), (3, 30, 9, 2)]
    rows += [(1, 11, 1, 4), (4, 40, 1, 5), (4, 41, 2, 5), (3, 31, 6, 1), (3, 31, 7, 1)] if clash else []
    found = spark.createDataFrame(rows, "hash long, other long, doc_id long, start int")
    got = sorted(map(tuple, suffixes.shared_stretches(found).collect()))
    assert got == sorted([(5, 0, 3), (3, 7, 3), (3, 9, 3), (8, 2, 8), (9, 2, 8)] + ([(6, 1, 6), (7, 1, 6)] if clash else []))


def test_first_of_equal_minimisers_is_taken_in_long_texts(monkeypatch):
    monkeypatch.setattr(suffixes, "PLACE_BITS", 6)
    rng = np.random.RandomState(5)
    for size in (30, 63, 64, 65, 500):
        h = rng.randint(0, 4, size).astype(np.uint64)  # many equal 8-grams
        h[size // 2 :] = 3
        doc = np.sort(rng.randint(0, 3, size))
        g = suffixes.tb.grams(h, suffixes.GRAM) & ~np.uint64(63)
        expect = set()
        for i in range(len(g) - 11):
            if doc[i] == doc[i + 12 + suffixes.GRAM - 2]:
                expect.add(i + int(np.argmin(g[i : i + 12])))
        assert suffixes.minimisers(h, doc, 12).tolist() == sorted(expect)


@pytest.mark.parametrize("places", [1 << 24, 16])
def test_decontamination(spark, monkeypatch, places):
    monkeypatch.setattr(decontam, "PLACES", places)  # places of long texts are known modulo this
    rng = random.Random(2)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (3, "three word Item"), (4, "b7"), (5, None), (6, "--"), (None, prose(rng, 15)), (7, prose(rng, 11)), (70, "e1 e2 e3 e4 e5 e6")]
    long = prose(rng, 500)
    texts = [None, "", items[0][1], items[0][1].upper(), f"{prose(rng, 30)} {' '.join(items[1][1].split()[1:11])} {long}", "a THREE, word; item!", "x b7 y b7", items[6][1], long]
    texts += [items[7][1] + " " + items[0][1][:60], " ".join(items[0][1].split()[:9]), "q e1 e2 e3 e4 e5 e6 e1 e2 e3 e4 e5"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[3]), (2, "other text of one id")]
    words = lambda t: ALNUM.findall(lower(t))
    expect = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            m = min(10, len(v))
            wins = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if v else set()
            at = [p for p in range(len(w) - m + 1) if tuple(w[p : p + m]) in wins] if v else []
            hit |= {q for p in at for q in range(p, p + m)}
            found |= {str(i)} if at and i is not None else set()
        expect.append((d, len(w), len(hit), len(found), sorted(found), bool(hit)))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = decontam.decontaminate(frame, bench).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated").collect()
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expect, key=key)
    assert decontam.decontaminate(frame.where("false"), bench).count() == 0
    assert decontam.decontaminate(frame, bench.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_top_k(spark):
    rng = np.random.RandomState(6)
    v = rng.randn(300, 8).round(2)
    v[50:120] = v[50]
    rows = [(i, [float(x) for x in r], "a") for i, r in enumerate(v)]
    more = {403: [1.0, 2.0], 404: []}  # shorter ones count as padded by zeros
    rows += [(400, None, "a"), (401, [float("nan")] * 8, "a"), (402, [1.0, None] + [0.0] * 6, "a"), (405, [float("inf")] * 8, "a"), (None, [0.5] * 8, "a"), rows[3]]
    rows += [(i, x, "a") for i, x in more.items()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    q = {i: np.floor(64 * x).astype(int) for i, x in enumerate(v)} | {i: np.floor(64 * np.array([*x, *[0.0] * (8 - len(x))])).astype(int) for i, x in more.items()}
    expect = []
    for i in (*range(0, 300, 20), 403, 404):
        s = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:20]
        expect += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    asks = (F.col("vec_id") % 20 == 0) | F.col("vec_id").isin(403, 404)
    for sizes in ({}, {"pivots": 7, "query_block": 2, "data_block": 40}):
        got = sorted(tuple(r) for r in knn.top_k(frame, asks, **sizes).where("query_id not in (400)").collect())
        assert got == sorted(expect)
    few = knn.top_k(frame.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert knn.top_k(frame.where("false"), F.col("vec_id") == 0).count() == 0
    assert knn.top_k(frame, F.lit(False)).count() == 0


def test_top_k_of_huge_components(spark):
    big = [[1e300, 1.0], [-1e300, 2.0], [3e16, 4.0], [0.5, 1e17], [1.0, -1.0]]
    low, high = -(1 << 63), (1 << 63) - 1
    q = [[int(min(max(np.floor(64 * x), low), high)) if abs(64 * x) < 2**63 else (high if x > 0 else low) for x in r] for r in big]
    got = knn.top_k(spark.createDataFrame(list(enumerate(big)), "vec_id long, embedding array<double>"), F.lit(True)).collect()
    for i in range(5):
        s = sorted((-min(max(sum(a * b for a, b in zip(q[i], q[j])), low), high), j) for j in range(5) if j != i)
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(j, -x) for x, j in s]


def test_vectors_go_only_where_they_are_needed(spark):
    rng = np.random.RandomState(3)
    centres = rng.randn(12, 16)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    near = centres[rng.randint(12, size=1200)] + 0.01 * rng.randn(1200, 16)
    frame = lambda v: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    sent = lambda v, block: knn.replicas(frame(v), F.col("vec_id") % 2 == 0, 5, "vec_id", "embedding", 64.0, 48, block, 4096)[1].count()
    assert sent(near, 60) < 3 * 1200  # of ten groups and more
    assert sent(rng.randn(1200, 16), 60) <= 20 * 1200  # no bound helps: once to each group
    assert sent(rng.randn(1200, 16), 1000) == 1200


def test_main_text(spark):
    model = htmltext.train(labelled_pages.pages())
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")

    def article(page):
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1])
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        return "\n\n".join(b for b in blocks if b)

    assert [htmltext.main_text(x, model) for x in pages.html] == [article(x) for x in pages.html]
    odd = """<HTML><body><header>Site</header><div class='cookie banner'><p>We use cookies</p></div><div id="main"><h1>Head</h1><p>Body &amp; more &lt;b&gt; of
    it here, quite long enough<p>Second <a href="x>y">link</a> para<script>if (a<b) "</p>"</script><div class=ad>Buy now</div><ul><li>one<li>two</ul>
    <div class="comments"><p>I like this</p></div><form><p>Search</p></form></div><footer>foot</footer>"""
    assert htmltext.main_text(odd, model) == "Head\n\nBody & more <b> of it here, quite long enough\n\nSecond link para\n\none\n\ntwo"
    labelled = "<body><article data-y='12px'><h1 data-y=0>Head</h1><p data-y=x>Some words that go on for a while here, and then some more.</p></article></body>"
    assert htmltext.main_text(labelled, model) == "Head\n\nSome words that go on for a while here, and then some more."
    deep = "<div>" * 3000 + "<p>" + "word " * 40 + "</p>"
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, odd, "x"), (4, deep, "x"), (5, "<", "x"), (3, odd, "x")], "page_id long, html string, text string")
    frame = frame.withColumn("_html", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("html_", F.lit(3))
    assert htmltext.extract(frame).columns == ["page_id", "_html", "a.b", "html_", "text", "n_chars"]
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(frame).collect()}
    assert got[1] == got[2] == ("", 0) and got[3][1] == len(got[3][0]) and len(got) == 5
    assert htmltext.extract(frame.where("false")).count() == 0


SENTENCE = "Water moves through the valley in every season and people have long made use of it for mills and fields. "
OTHER_LAYOUTS = {
    "title in a header": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{SENTENCE * 3}</p></article><footer>foot</footer>", "Title|TTT"),
    "comments in a section": (f"<main><h1>Title</h1><p>{SENTENCE}</p><p>{SENTENCE * 2}</p></main><section class=comments><h2>Responses</h2><article class=comment><p>{SENTENCE}</p></article></section>", "Title|T|TT"),
    "heading before comments": (f"<div class=post><h1>Title</h1><p>{SENTENCE * 3}</p><h3>Responses</h3><ol class='commentlist'><li><p>{SENTENCE}</p></li></ol></div>", "Title|TTT"),
    "math and objects": (f"<article><h1>Title</h1><p>Water is <math><mi>H</mi><mn>2</mn><mi>O</mi></math> <object>or so</object>. {SENTENCE * 2}</p></article>", "Title|Water is H2O or so. TT"),
    "divisions": (f"<div class='topnav menu'><a href=1>Home</a> <a href=2>News</a></div><div class=story><h1>Title</h1><p>{SENTENCE * 2}</p><div class=promo>Buy</div><ul><li>one<li>two</ul></div><div class=related><a href=1>Other</a></div>", "Title|TT|one|two"),
    "a table": (f"<table><tr><td class=menu><a href=1>A</a><a href=2>B</a></td></div><td class=main><h1>Title</h1><p>{SENTENCE * 2}</p></td></tr></table>", "Title|TT"),
    "an unclosed page": (f"<nav><a href=1>A</nav><div id=content><h1>Title<p>{SENTENCE * 2}<p>{SENTENCE}</div><div id=footer>foot", "Title|TT|T"),
    "main and aside": (f"<main><h1>Title</h1><p>{SENTENCE}</p><blockquote>{SENTENCE}</blockquote><pre>some\n code</pre></main><aside class=ads>Buy</aside>", "Title|T|T|some code"),
    "inline elements over blocks": (f"<article><h1>Title</h1><b><p>{SENTENCE}</b>{SENTENCE}</p><p title='a>b'>{SENTENCE}</p></article><script>if (a < b) document.write('<p>')</script >", "Title|TT|T"),
    "a form and a notice": (f"<div id='cookie-consent'>We use cookies <button>OK</button></div><article><h1>Title</h1><p>{SENTENCE * 2}</p><form><p>Search</p><textarea>x</textarea></form></article>", "Title|TT"),
}


@pytest.mark.parametrize("name", sorted(OTHER_LAYOUTS))
def test_main_text_of_layouts_not_trained_on(name):
    page, expect = OTHER_LAYOUTS[name]
    got = htmltext.main_text(f"<html><body>{page}</body></html>", htmltext.train(labelled_pages.pages()))
    assert got.replace(SENTENCE.strip() + " ", "T").replace(SENTENCE.strip(), "T").replace("\n\n", "|") == expect


def test_parsing_takes_linear_time():
    import time

    model = htmltext.train(labelled_pages.pages())
    n = 100_000
    for page in ("<div>" * n + "</x>" * n, "<a" * n, "<a \"'>" * n, "<p><button>" + "<div>" * n, "<b>" * n + "<p>" * n + "</b>" * n, "<!--" * n, '<a "' * n + ">", "</script " * n):
        began = time.process_time()
        htmltext.parse(page)
        assert time.process_time() - began < 8, page[:20]
    assert htmltext.main_text("</p>" * n, model) == ""


def test_marginals_are_those_of_all_labellings():
    model = htmltext.train(labelled_pages.pages())
    t = htmltext.parse("<body><nav><a href=x>a</a></nav><div><p>text here</p><p>more</p></div></body>")
    n, total, ones = len(t.parent), 0.0, [0.0] * len(t.parent)
    alike = {}
    for i in range(1, n):
        alike[t.parent[i], t.features[i][0]] = alike.get((t.parent[i], t.features[i][0]), 0) + 1
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = 1.0 if y[0] else 0.01
        for i in range(1, n):
            k = 2 * y[t.parent[i]] + y[i]
            p *= model.edge[k]
            for f in t.features[i]:
                if f in model.likelihood:
                    p *= model.likelihood[f][k] ** min(1.0, htmltext.ALIKE / alike[t.parent[i], t.features[i][0]])
        total += p
        ones = [o + p * b for o, b in zip(ones, y)]
    np.testing.assert_allclose(htmltext.marginals(t, model), [o / total for o in ones], atol=1e-9)


def labelled_documents(rng, n):
    texts, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(rng, rng.randint(5, 60)).split()
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "awful"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 1 if i % 5 else 0, int(bad)))
    return texts, labels


def test_toxicity(spark):
    rng = random.Random(9)
    texts, labels = labelled_documents(rng, 400)
    extra = [(1000, None), (1001, ""), (1002, "vile " * 5000), (None, "vile nasty awful"), texts[0]]
    docs = spark.createDataFrame([(*r, "s", 1) for r in [*texts, *extra]], "doc_id long, text string, Score string, `a.b` int")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (2000, 1, 1)], "doc_id long, quality int, toxic int")
    learn = known.where("doc_id % 3 <> 1 or doc_id is null")
    model = toxicity.fit(docs, learn)
    got = toxicity.score(docs, model).toPandas()
    assert len(got) == len(texts) + len(extra) and got.score.between(0, 1).all() and list(got.columns) == ["doc_id", "a.b", "score", "predicted", "evidence"]
    held = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").loc[[i for i, _ in texts if i % 3 == 1]]
    assert (held.predicted == [int(i % 4 == 0) for i in held.index]).mean() > 0.98
    assert got[got.doc_id == 1002].predicted.all() and got[got.doc_id.isna()].predicted.all() and not got[got.doc_id.isin([1000, 1001])].predicted.any()
    none = toxicity.fit(docs, learn.where("false"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(docs.where("false"), model).count() == 0
    assert toxicity.score(docs, model, keep_text=True).columns[:2] == ["doc_id", "text"]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_examples_are_those_of_the_dense_product(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "POSTINGS", 50)
    rng = np.random.RandomState(block)
    dense = np.where(rng.rand(90, 60) < 0.15, rng.rand(90, 60), 0)  # by example and word
    dense[40:44] = dense[40]  # ties
    dense[70] = 0
    example, word = np.nonzero(dense)
    shuffled = rng.permutation(len(word))
    index = toxicity.Index.build(word[shuffled], example[shuffled], dense[example, word][shuffled], 60, 90)
    for k in (1, 3, 15, 200):
        for terms in (np.arange(60), np.array([5]), np.sort(rng.choice(60, 7, False)), np.zeros(0, int)):
            w = rng.randint(1, 3, len(terms)).astype(float)
            s = sum((x * dense[:, t] for t, x in zip(terms, w)), np.zeros(90))
            order = [j for j in np.lexsort((np.arange(90), -s)) if s[j] > 0][:k]
            places, cosines = index.nearest(terms, w, k)
            np.testing.assert_allclose(cosines, s[order])
            assert places.tolist() == order


def test_toxicity_counts_every_word(spark):
    rng = random.Random(10)
    texts, labels = labelled_documents(rng, 400)
    long = [" ".join([prose(rng, 4000), *["vile"] * bad]) for bad in (0, 1)]
    outside = [f"vile nasty {' '.join(f'unseen{i}' for i in range(m))}" for m in (0, 40)]
    docs = spark.createDataFrame([*texts, *enumerate(long + outside, 2000)], "doc_id long, text string")
    learn = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 <> 1")
    model = toxicity.fit(docs, learn)
    by_id = dict([*texts, *enumerate(long + outside, 2000)])
    words = {i: ALNUM.findall(lower(t)) for i, t in by_id.items()}
    assert len(model.words) == len({w for i in model.ids for w in words[i]})
    hashes, distinct = {}, sorted({w for x in words.values() for w in x})
    for w in distinct:
        hashes[w] = int(toxicity.places(model.words, toxicity.word_counts(pa.array([w]))[1])[0])

    def vector(ws):
        v = {w: (1 + np.log(ws.count(w))) * (model.factor[hashes[w]] if hashes[w] >= 0 else model.other) for w in set(ws)}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    # the factors are those of TF-IDF times the lean, by brute force
    label = {i: t for i, _, t in labels}
    held = np.array([[w in set(words[i]) for i in model.ids] for w in distinct])
    y = np.array([label[i] for i in model.ids])
    phi = {w: 0.0 if h.all() or not h.any() else abs(np.corrcoef(h, y)[0, 1]) for w, h in zip(distinct, held)}
    assert model.ids.tolist() == sorted(model.ids.tolist()) and model.labels.tolist() == y.tolist()
    for w in distinct:
        if hashes[w] >= 0:
            idf = np.log((1 + len(by_id)) / (1 + sum(w in set(x) for x in words.values())))
            np.testing.assert_allclose(model.factor[hashes[w]], idf * (model.floor + (1 - model.floor) * phi[w] / max(phi.values())), atol=1e-9)
    shown = [vector(words[i]) for i in model.ids]
    got = {r.doc_id: r for r in toxicity.score(docs, model, evidence=model.k).collect()}
    for i in [1, 4, 7, 40, 2000, 2001, 2002, 2003]:
        v = vector(words[i])
        cosines = sorted((sum(x * e.get(w, 0.0) for w, x in v.items()) for e in shown), reverse=True)
        np.testing.assert_allclose([e.cosine for e in got[i].evidence], [c for c in cosines[: model.k] if c > 0], atol=1e-9)
        share = (sum(e.cosine * e.label for e in got[i].evidence) + 0.5 * model.base) / (sum(e.cosine for e in got[i].evidence) + 0.5)
        np.testing.assert_allclose(got[i].score, 1 / (1 + np.exp(-model.curve[0] * share - model.curve[1])), atol=1e-9)
    # one bad word doesn't decide over thousands of others, and words of no example count in the length
    assert got[2000].score < 0.1 and got[2001].score < 0.5 and not got[2001].predicted
    assert got[2002].predicted and got[2003].evidence[0].cosine < 0.6 * got[2002].evidence[0].cosine


def test_mixing(spark):
    rng = random.Random(4)
    texts, labels = labelled_documents(rng, 300)
    docs = spark.createDataFrame([(i, t, 1) for i, t in [*texts, (900, None), (901, ""), (None, "x y z"), texts[5]]], "doc_id long, text string, rate int")
    known = spark.createDataFrame([(i, "bad" if t else "good") for i, _, t in labels] + [(None, "bad"), (4, None), (5, "other")], "doc_id long, domain string")
    got = mixing.mix(docs, known, {"good": 0.9, "bad": 0.1}, rounds=4).toPandas()
    p = np.array(got.posterior.tolist())
    assert len(got) == 304 and (got.rate >= 0).all() and np.allclose(p.sum(1), 1)
    totals = (p * (got.rate * got.n_tokens).to_numpy()[:, None]).sum(0)
    np.testing.assert_allclose(totals / got.n_tokens.sum(), [0.1, 0.9], atol=2e-3)
    truth = got.dropna(subset=["doc_id"]).set_index("doc_id").loc[range(300)]
    assert ((np.array(truth.posterior.tolist())[:, 0] > 0.5) == [i % 4 == 0 for i in truth.index]).mean() > 0.95
    # a least rate keeps all, and copies average to the rate
    raised = mixing.mix(docs, known, {"good": 0.5, "bad": 0.5}, least=1.0, rounds=4)
    out = raised.toPandas()
    assert out.rate.min() >= 1 and mixing.drawn(raised, "doc_id").count() == pytest.approx(out.rate.sum(), rel=0.1)
    fewer = mixing.mix(docs, known, {"good": 0.9, "bad": 0.1}, keep_text=False, rounds=4).toPandas()
    assert "text" not in fewer.columns and sorted(fewer.rate) == pytest.approx(sorted(got.rate))
    assert set(mixing.drawn(raised, "doc_id").select("doc_id").distinct().toPandas().doc_id.fillna(-1)) == set(out.doc_id.fillna(-1))
    assert mixing.mix(docs.where("false"), known, {"good": 0.5, "bad": 0.5}, rounds=4).count() == 0
    assert mixing.mix(docs, known.where("false"), {"good": 0.5, "bad": 0.5}, rounds=4).count() == 304


def test_gradient_steps_reach_the_least_squares_optimum(spark):
    rng = np.random.RandomState(1)
    p = rng.dirichlet([1, 1, 1], 80)
    n = rng.randint(1, 50, 80)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    plan = mixing.solve(rows, [0.2, 0.3, 0.5])
    r = np.ones(80)
    for s in plan.steps:
        r = np.maximum(0, r - p @ np.array(s))
    np.testing.assert_allclose((r * n) @ p, plan.reached, rtol=1e-9)
    np.testing.assert_allclose(plan.reached, plan.targets, atol=2e-3 * n.sum())
    assert mixing.solve(rows.where("false"), [1.0, 1.0]).steps == []
    # of all rates that meet the targets the nearest to 1, by alternating projections of numpy alone
    r, off = np.ones(80), np.zeros(80)
    a, target = (n[:, None] * p).T, np.array([0.2, 0.3, 0.5]) * n.sum()
    for _ in range(20_000):
        flat = r - (p @ np.linalg.solve(a @ p, a @ r - target))
        r, off = np.maximum(0, flat + off), np.minimum(0, flat + off)
    own = np.ones(80)
    for s in plan.steps:
        own = np.maximum(0, own - p @ np.array(s))
    np.testing.assert_allclose(a @ r, target, rtol=1e-3)
    np.testing.assert_allclose(own, r, atol=5e-3)


def test_posteriors_against_brute_force(spark):
    rng = random.Random(14)
    texts, labels = labelled_documents(rng, 240)
    texts += [(900, None), (901, ""), (902, " ".join(x for _, x in texts[:60])), (903, "never seen words")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in texts], "doc_id long, text string, b int, x int, e int")
    known = spark.createDataFrame([(i, "bad" if t else "good") for i, _, t in labels], "doc_id long, domain string")
    for sample, checks in ((1500, 500), (40, 20)):
        model = mixing.fit(docs, known, ["bad", "good"], sample=sample, checks=checks, rounds=4)
        assert 0 < model.scale
        got = mixing.with_posteriors(docs, model)
        assert got.columns == ["doc_id", "text", "b", "x", "e", "n_tokens", "posterior"]
        bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in {w for _, t in texts for w in ALNUM.findall(lower(t))}], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) as b").collect()}
        for r in got.collect():
            words = ALNUM.findall(lower(r.text))
            held = sorted({bucket[w] for w in words})
            rare, by_word = np.array(model.rarity)[held], np.array(model.weights[0])[held]
            long, new = (np.log1p(len(words)) - 5) / 2, 4 * len(held) / max(1, len(words)) - 3
            odds = 5 * (rare @ by_word) / max(1e-9, np.sqrt(rare @ rare)) + np.array(model.weights[0][mixing.BIAS :]) @ [1, long, long * long, new, new * new]
            prior = model.prior[1] - model.prior[0]
            z = np.array([0.0, (odds - prior) * model.scale + prior if words else prior])
            assert r.n_tokens == len(words)
            np.testing.assert_allclose(r.posterior, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)
    total = {d: sum((t == 1) == (d == "bad") for _, _, t in labels) for d in ("bad", "good")}
    np.testing.assert_allclose(np.exp(model.prior), [(total[d] + 1) / 242 for d in ("bad", "good")])


SAID = "Some running text of the article that goes on for a while and says what there is to say."
SAID_TWICE = f"<p>{SAID} {SAID}</p>"
IN_ARTICLE = {
    "a list of sources": ("<ul><li><a href=x>Source one</a></li><li><a href=y>Source two</a></li><li><a href=z>Source three</a></li></ul>", ["Source one", "Source two", "Source three"]),
    "a table of links": ("<table><tr><td><a href=x>One</a></td><td><a href=y>Two</a></td></tr></table>", ["One", "Two"]),
    "a linked heading": ("<h2><a href=x>Linked heading</a></h2>", ["Linked heading"]),
    "a linked paragraph": (f"<p><a href=x>{SAID}</a></p>", [SAID]),
    "a caption with a link": ("<figure><img src=x><figcaption>Photo by <a href=y>Someone Known</a></figcaption></figure>", ["Photo by Someone Known"]),
    "a linked caption": ("<figure><img src=x><figcaption><a href=y>Someone Known</a></figcaption></figure>", ["Someone Known"]),
    "a heading with id search": ('<h2 id="search">Search for meaning</h2>', ["Search for meaning"]),
    "a heading with id legal": ('<h2 id="legal">Legal matters</h2>', ["Legal matters"]),
    "a heading with id comment": ("<h3 id=comment-on>Comment on this</h3>", ["Comment on this"]),
    "noscript": ("<noscript>Picture of a river</noscript>", ["Picture of a river"]),
    "noscript with a paragraph": ("<noscript><p>Picture of a river</p></noscript>", ["Picture of a river"]),
}


@pytest.mark.parametrize("part", sorted(IN_ARTICLE))
def test_parts_of_articles_stay(part):
    inside, blocks = IN_ARTICLE[part]
    model, text = htmltext.train(labelled_pages.pages()), f"{SAID} {SAID}"
    article = f"<h1><a href=t>Linked title</a></h1>{SAID_TWICE}{inside}{SAID_TWICE}"
    for page in (
        f"<html><body><header><a href=x>Site</a></header><nav><a href=a>Home</a><a href=b>News</a></nav><main><article>{article}</article></main><footer><p>Copyright</p></footer></body></html>",
        f"<html><body><div id=header>Site</div><div id=content>{article}</div><div class=sidebar><ul><li><a href=q>Elsewhere</a></li></ul></div><div id=footer>Imprint</div></body></html>",
        f"<article>{article}<aside><ul><li><a href=q>Elsewhere</a></li></ul></aside></article>",
    ):
        assert htmltext.main_text(page, model).split("\n\n") == ["Linked title", text, *blocks, text]


def test_short_pages_stay_whole():
    model = htmltext.train(labelled_pages.pages())
    for s in ("S", SAID):
        assert htmltext.main_text(f"<article><h1>Title</h1><p>{s}</p><p><a href=x>{s}</a></p><p>{s}</p></article>", model) == f"Title\n\n{s}\n\n{s}\n\n{s}"
    for tag in ("section", "div"):
        page = f'<html><body><{tag} class="response-time"><h1>Response time</h1><p>{SAID}</p></{tag}></body></html>'
        assert htmltext.main_text(page, model) == f"Response time\n\n{SAID}"


def test_mixing_moves_labelled_shares_to_the_targets(spark):
    """Real labels, a third of them held out: better than the prior, and their true shares of tokens come near the targets."""
    folder, domains = "/root/testdata/sf0.1", ["high", "low", "toxic"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = queries.domains_of(spark.read.parquet(f"{folder}/labels.parquet"))
    known = labels.where("pmod(doc_id, 3) <> 0")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    mixed = mixing.mix(docs, known, dict(zip(domains, (0.95, 0.04, 0.01), strict=True)), keep_text=False)
    rows = mixed.join(labels.where("pmod(doc_id, 3) = 0"), "doc_id").where("n_tokens > 0").toPandas()
    own = [p[domains.index(d)] for p, d in zip(rows.posterior, rows.domain, strict=True)]
    share = rows.domain.value_counts(normalize=True)
    assert -np.log(own).mean() < 0.75 * -(share * np.log(share)).sum()
    before = rows.groupby("domain").n_tokens.sum() / rows.n_tokens.sum()
    after = (rows.n_tokens * rows.rate).groupby(rows.domain).sum() / (rows.n_tokens * rows.rate).sum()
    assert before.toxic > 0.09 and after.toxic < 0.35 * before.toxic and after.low < before.low and after.high > 0.88


def test_copies_are_drawn_by_thousands(spark):
    rows = spark.createDataFrame([(1, 2500.0, 7), (2, 0.0, 7), (3, None, 7), (4, 1.0, 7)], "doc_id long, rate double, copies int")
    got = mixing.drawn(rows, "doc_id")
    assert got.columns == rows.columns and {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 2500, 4: 1}


def test_mixing_meets_strong_weights_and_reports_unmet_ones(spark):
    rng = np.random.RandomState(7)
    n = rng.randint(1, 400, 3000)
    kind = rng.choice(3, 3000, p=[0.8, 0.1, 0.1])
    z = rng.randn(3000, 3) + 4 * np.eye(3)[kind]
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    for weights, least in (([0.05, 0.04, 0.91], 0.0), ([0.02, 0.95, 0.03], 0.0), ([0.3, 0.4, 0.3], 0.5)):
        plan = mixing.solve(rows, weights, None, least)
        r = np.full(3000, 1.0)
        for s in plan.steps:
            r = np.maximum(least, r - p @ np.array(s))
        np.testing.assert_allclose((r * n) @ p, plan.reached, rtol=1e-9)
        np.testing.assert_allclose(plan.reached, plan.targets, rtol=1.01e-3)
        assert plan.met
    # no rates meet these: every document is at least 0.2 of the second domain
    q = [0.2, 0.5, 0.9]
    docs = spark.createDataFrame([(10, [1 - x, x]) for x in q], "n_tokens long, posterior array<double>")
    plan = mixing.solve(docs, [0.99, 0.01])
    g = np.array([sum(10 * (1 - x) ** 2 for x in q), sum(10 * x * x for x in q)])
    best = min(((np.array([8.0, 2.0]) * r - plan.targets) ** 2 / g).sum() for r in np.linspace(0, 10, 100_001))  # the first alone is seen
    assert not plan.met and plan.optimal and ((np.array(plan.reached) - plan.targets) ** 2 / g).sum() == pytest.approx(best, rel=1e-4)


def test_mixing_reports_what_it_reached(spark, tmp_path):
    texts, labels = labelled_documents(random.Random(4), 200)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(i, "bad" if t else "good") for i, _, t in labels], "doc_id long, domain string")
    mixing.mix(docs, known, {"good": 0.9, "bad": 0.1}, unmet="raise", rounds=4).write.parquet(str(tmp_path / "mixed"))
    told = mixing.report(spark.read.parquet(str(tmp_path / "mixed")))
    assert told["domains"] == ["bad", "good"] and told["met"]
    np.testing.assert_allclose(told["reached"], told["targets"], rtol=1e-3)
    with pytest.warns(UserWarning, match="not met"):
        assert not mixing.report(mixing.mix(docs, known, {"good": 0.5, "bad": 0.25, "none": 0.25}, rounds=4))["met"]
    with pytest.raises(ValueError, match="not met"):
        mixing.mix(docs, known, {"good": 0.5, "bad": 0.25, "none": 0.25}, unmet="raise", rounds=4)


def test_rounds_of_mixing_share_their_code(spark):
    rng = np.random.RandomState(3)
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(rng.randint(1, 50, 60), rng.dirichlet([1, 1, 1], 60))], "n_tokens long, posterior array<double>")
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount
    mixing.solve(rows, [0.2, 0.3, 0.5])
    before = compiled()
    assert mixing.solve(rows, [0.25, 0.45, 0.3]).met
    assert compiled() - before <= 2
    # totals of several multipliers at once, and of no rows
    p, n = (np.array(x.tolist()) for x in (rows.toPandas().posterior, rows.toPandas().n_tokens))
    points = [np.array(x) for x in ([0.0, 0.0, 0.0], [0.3, -0.2, 2.0])]
    for x, (totals, fall) in zip(points, mixing._totals(rows, points, 0.0), strict=True):
        rate = np.maximum(0, 1 - p @ x)
        np.testing.assert_allclose(totals, (n * rate) @ p)
        np.testing.assert_allclose(fall, (p * (n * (rate > 0))[:, None]).T @ p)
    assert all((t == 0).all() and (f == 0).all() for t, f in mixing._totals(rows.where("false"), points, 0.0))


def test_rounds_of_mixing_start_no_threads_of_adaptive_plans(spark, monkeypatch):
    texts, labels = labelled_documents(random.Random(4), 100)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(i, "bad" if t else "good") for i, _, t in labels], "doc_id long, domain string")
    names = lambda: {t.getId() for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet() if t.getName().startswith(("shuffle-exchange", "ResultQueryStage"))}
    started = {}

    def counted(name):
        work = getattr(mixing, name)

        def run(*given, **more):
            before = names()
            out = work(*given, **more)
            started[name] = len(names() - before)
            return out

        return run

    for name in ("_search", "solve"):
        monkeypatch.setattr(mixing, name, counted(name))
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    assert mixing.mix(docs, known, {"good": 0.5, "bad": 0.5}, rounds=2).count() == len(texts)
    assert started == {"_search": 0, "solve": 0}
    assert [spark.conf.get(k) for k in keys] == before


def test_toxicity_sends_small_batches(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf, key, seen = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxBytesPerBatch", {}
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gather, write = type(docs).toArrow, corpus_pipeline.materialize
    monkeypatch.setattr(type(docs), "toArrow", lambda df: seen.setdefault("fit", []).append(spark.conf.get(key)) or gather(df))
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: seen.setdefault(label, spark.conf.get(key)) and write(df, label))
    out = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert seen == {"fit": ["4m", "4m"], "clean": "4m"} and spark.conf.get(key) == before
    assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "token_files":
            assert out.columns == docs.columns
            ids, before = set(out.toPandas().doc_id), set(docs.toPandas().doc_id)
            assert ids <= before and ids
            if name == "mixing":
                assert ids == before
            if name == "jaccard_join":
                assert out.count() == len(ids)
        docs = out if name != "token_files" else docs
    assert set(out.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"} and out.count() == docs.count()
    assert len(known) > docs.select("doc_id").distinct().count()
    empty = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    item = pd.read_parquet(f"{sf}/benchmark.parquet").text.dropna().tolist()
    texts = given.toPandas().text.tolist()
    odd = [(None, "no id here", "x"), (9001, None, "x"), (9002, "", "x"), (9003, item[0], "x"), (9004, "word " * 20_000, "x"), (9005, texts[0], "x"), (9001, None, "x"), (None, None, None)]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema))
    docs = docs.withColumnRenamed("source", "score").withColumn("a.b", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("rate", F.lit(3)).withColumn("_d", F.lit(4))
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    held = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows, got = docs.select("doc_id", "text").collect(), out.collect()
        if name != "token_files":
            assert out.columns == docs.columns
        if name == "toxicity":
            kept = {(r.doc_id, r.text) for r in got}
            assert len(got) == sum((r.doc_id, r.text) in kept for r in rows) and {(None, "no id here"), (9001, None), (9002, ""), (None, None)} <= kept
        elif name == "jaccard_join":
            nodes = sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, key=lambda r: (r[0], str(r[1])))
            sets, group = [shingles(t) for _, t in nodes], list(range(len(nodes)))
            for i in range(len(nodes)):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                        a, b = sorted((group[i], group[j]))
                        group = [a if g == b else g for g in group]
            expect = [nodes[g] for g in sorted(set(group))] + [(r.doc_id, r.text) for r in rows if r.doc_id is None]
            assert key(got) == sorted(expect, key=str)
        elif name == "decontamination":
            windows = set()
            for x in item:
                w = ALNUM.findall(lower(x))
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(w) for w in windows}
            bad = lambda t: any(tuple(w[i : i + m]) in windows for w in [ALNUM.findall(lower(t))] for m in sizes for i in range(len(w) - m + 1))
            assert key(got) == sorted(((r.doc_id, r.text) for r in rows if not bad(r.text)), key=str) and not any(r.doc_id == 9003 for r in got)
        elif name == "mixing":
            copies = {k: key(got).count(k) for k in set(key(got))}
            assert set(copies) == set(key(rows)) and min(copies.values()) == 1
        else:
            ids = {(r.doc_id, r.text): [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
            crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
            assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id or -1, len(ids[r.doc_id, r.text]), crc(ids[r.doc_id, r.text])) for r in rows)
            assert sorted(r.start for r in got) == [0, *np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1]]
        held.append(out)
        docs = out if name != "token_files" else docs


def test_groups_keep_unlike_texts_of_one_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(5, a), (5, b), (7, near_copy(rng, a, 2)), (3, near_copy(rng, b, 2)), (9, c), (9, c), (4, None), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[3], rows[4], rows[6], rows[7]], key=str)


def test_buckets_are_those_of_crc32(spark):
    from thawline.llm.common import bucket_of

    got = spark.range(50).select("id", bucket_of("id", 4).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 4 for r in got)
