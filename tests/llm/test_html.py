"""Blocks of pages, the network's gradients, and extraction against plain cutting."""

import html
import pathlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_labeller as labeller
from tidemark.llm.html_blocks import blocks

ROOT = pathlib.Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    return labeller.trained(spark.read.parquet(f"{SF}/pages.parquet"), 150)


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> \n </p><!-- a <p>b</p> -->") == []
    assert texts("<head><title>t</title></head><p>a &amp; b\n\n c&nbsp;d<br>e<p>f <b>g</b>h<ul><li>i<li>j</ul>k") == ["a & b c d e", "f gh", "i", "j", "k"]
    assert texts("<script>var t='</p>';</script><style>p{}</style>x < y & z<script>never closed") == ["x < y & z"]
    assert texts("<p title='a>b'>c</p><p title=\"open>d</p><!-- open") == ["c", "d"]
    assert [b.path for b in blocks('<div class="Ad big" id=x><p>a</p></div>b')] == [("div ad big x", "p"), ()]
    assert texts("<p>Let <math><mi>x</mi></math> be 5.</p><svg><p>rest <object>of it</object><video>all</p>") == ["Let x be 5.", "rest of itall"]
    assert texts("a<template>b<p>c</p>d") == ["ab", "c", "d"]
    assert [b.path for b in blocks("<p><b>a<br><p>b")] == [("p", "b"), ("p",)]
    assert blocks("<li><a href=x>abc</a> d</li>")[0].links == 3
    assert len(texts("<p>x" * 20_000)) == 20_000


@pytest.mark.parametrize("pattern", ["<b ", "<b>t ", "<div>t ", "<li>t ", "<p>t ", "<a href='", '<b "', "<!-- ", "<!", "<template>", "<td>t<table>", "</b>", "&amp", "<b '>\"", "<x/ "])
def test_hostile_pages_take_linear_time(pattern):
    begin = time.perf_counter()
    blocks(pattern * (1_000_000 // len(pattern)))
    blocks(pattern * (1_000_000 // len(pattern)) + ">")
    assert time.perf_counter() - begin < 30  # each under 2 s on a quiet machine; hours before


def test_wrappers_lose_their_names():
    page = '<body class="single has-sidebar"><form id=f><div class="content-sidebar-wrap"><nav class=menu>Home</nav><article><h1>T</h1><p>%s</p></article><div class=comments>Nice</div></div></form></body>' % ("word " * 50)
    assert [b.path for b in blocks(page)] == [("body", "div", "div", "nav menu"), ("body", "div", "div", "article", "h1"), ("body", "div", "div", "article", "p"), ("body", "div", "div", "div comments")]
    page = "<body><article><h1>T</h1><p>short</p></article><div class=comments>%s</div></body>" % ("a long comment " * 20)
    assert blocks(page)[-1].path == ("body", "div comments")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = labeller.Network.fresh(rng)
    net.weights = [w.astype(np.float64) for w in net.weights]
    net.out = net.out.astype(np.float64)
    x, lengths = labeller.padded([rng.standard_normal((n, labeller.INPUT)) for n in (3, 5)])
    x = x.astype(np.float64)
    y = (rng.random(x.shape[:2]) < 0.5).astype(float)
    inside = np.arange(len(x))[:, None] < lengths

    def loss():
        p = net.chances(x, lengths)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * inside).sum() / inside.sum()

    for values, grad in zip([*net.weights, net.out], net.gradients(x, lengths, y)):
        for at in [tuple(rng.integers(0, s) for s in values.shape) for _ in range(8)]:
            kept = values[at]
            values[at] = kept + 1e-3
            up = loss()
            values[at] = kept - 1e-3
            down = loss()
            values[at] = kept
            assert grad[at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_padding_does_not_matter(net):
    rng, features = np.random.default_rng(1), labeller.Features()
    pages = [labeller.laid_out(["one text", "two texts. And more", "three"] * int(rng.integers(1, 4)), ["menu"], rng)[0] for _ in range(12)]
    together = labeller.label(net, pages, features)
    assert all((a == labeller.label(net, [p], features)[0]).all() for a, p in zip(together, pages))


def test_extraction_of_the_test_pages(spark, net):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = {r.page_id: r for r in labeller.extract(pages, net).collect()}
    wrong = 0
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        wrong += got[r.page_id].text != "\n".join(filter(None, parts))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert wrong <= len(got) // 200


@pytest.mark.parametrize("around", ['<body class="single has-sidebar search-enabled">%s</body>', '<div class="content-sidebar-wrap">%s</div>', '<form id="form1">%s</form>'])
def test_names_around_the_whole_page_do_not_matter(spark, net, around):
    features, found, wanted, shown = labeller.Features(), 0, 0, 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(100).collect():
        inner = r.html.partition("<body")[2].partition(">")[2].partition("</body>")[0] or r.html
        page = blocks(around % inner)
        good = labeller.label(net, [page], features)[0]
        want = [any(e.startswith("article") for e in b.path) for b in page]
        found += sum(g and w for g, w in zip(good, want))
        wanted, shown = wanted + sum(want), shown + int(good.sum())
    assert found / wanted > 0.95 and found / shown > 0.95


def test_parts_that_the_sample_lacks(net):
    rng, features = np.random.default_rng(8), labeller.Features()
    lines = ["A first line of an article that says something.", "And then the next one follows, with more words in it.", "The last one is short."]
    right = total = 0
    for _ in range(150):
        page, labels = labeller.laid_out(lines, ["Home", "About us", "Subscribe to our letter now"], rng)
        right += (labeller.label(net, [page], features)[0] == labels).sum()
        total += len(labels)
    assert right / total > 0.98


def test_odd_pages(spark, net):
    rows = [(None, None, "<article><p>Some words in here.</p></article>"), (1, "u", None), (2, "u", ""), (2, "u", ""), (3, None, "plain"), (4, "u", "<article>" + "<p>A sentence of words.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = labeller.extract(pages, net)
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert {(r.page_id, r.text) for r in got.collect() if r.page_id in (1, 2)} == {(1, ""), (2, "")}
    assert labeller.extract(pages.filter("page_id = 99"), net).count() == 0
    assert labeller.trained(pages.filter("page_id = 99")) is None
    assert {r.text for r in labeller.extract(pages, None).collect()} == {""}
