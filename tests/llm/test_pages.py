"""Main text of pages: against a plain extraction, markup of every kind, long pages, odd tables."""

import html
import os
import re
import tracemalloc

import pytest

from tessel.llm import html_extract as H
from tessel.llm.html_blocks import DEPTH, blocks

TABLES = "/root/testdata/sf0.01"


def plain_article(page: str) -> str:
    """The article of a page of the test tables, by patterns that know how these pages are written."""
    m = re.search(r"(?s)<article>(.*?)</article>", page)
    lines = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", m[1] if m else "")
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in lines.split("\n")]
    return "\n".join(x for x in lines if x)


def texts(pages: list[str]) -> list[str]:
    found = [blocks(x) for x in pages]
    good = H.label([H.Page(b) for b in found], H.trained())
    return ["\n".join(b.text for b, p in zip(own, ps.tolist(), strict=True) if p >= 0.5) for own, ps in zip(found, good, strict=True)]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_every_page_of_the_tables_equals_the_plain_extraction(spark):
    rows = spark.read.parquet(f"{TABLES}/pages.parquet").select("page_id", "url", "html").collect()
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r.page_id: plain_article(r.html or "") for r in rows} and len(got) == len(rows)


def test_only_silent_elements_lose_their_text():
    page = '<p>Energy is <math><mi>E</mi></math> here.<noscript><p>for readers</p></noscript><svg/><svg><text>label</text></svg><object>left open<p>more</p><video><p>film</video><template>never</template><select><option>one</select><title>no</title><textarea>no</textarea><style>no</style><p>last'
    assert [b.text for b in blocks(page)] == ["Energy is E here.", "for readers", "labelleft open", "more", "film", "last"]
    assert [b.text for b in blocks("<p>a<template>b<p>c<select>d<p>e<script>f<p>g")] == ["a", "b", "c", "d", "e"]
    assert [b.text for b in blocks("<p>a<STYLE>b</style\n>c</p>")] == ["ac"]


def test_broken_markup_takes_linear_time():
    hard = ["<div>" * 50_000 + "x", "<b>x<br>" * 50_000, "<a " * 50_000, "<p>t<a " + 'x="y" ' * 300, "<select><option>q" * 20_000, "</p>" * 50_000 + "<p>x"]
    found = [blocks(x) for x in hard]
    assert [len(x) for x in found] == [1, 50_000, 1, 1, 20_000, 1]
    assert len(found[0][0].path) == 2 * DEPTH


def test_a_page_of_many_blocks_takes_little_memory():
    n = 50_000
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1>" + "".join(f"<p>paragraph number {i} of it" for i in range(n)) + "</article><footer>&copy; f</footer>"
    small = "<article><h1>Some title</h1><p>some words here.</p></article>"
    H.trained()
    tracemalloc.start()
    got = texts([page] + [small] * 63)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].count("\n") == n and got[1:] == ["Some title\nsome words here."] * 63
    assert peak < 300 << 20


def test_batches_do_not_change_labels(monkeypatch):
    import random

    rng = random.Random(9)
    pages = [H.Page(b) for b in (blocks(H.synthetic_page(rng)[0]) for _ in range(40)) if b]
    want = H.label(pages, H.trained())
    for most in (1, 7, 300):
        monkeypatch.setattr(H, "BLOCKS", most)
        assert all(abs(a - b).max() < 1e-5 for a, b in zip(H.label(pages, H.trained()), want, strict=True))


def test_labels_equal_the_training_pass():
    import random

    import numpy as np

    rng, net = random.Random(10), H.trained()
    pages = [H.Page(b) for b in (blocks(H.synthetic_page(rng)[0]) for _ in range(30)) if b]
    x, mask, each = H._padded(pages, net)
    states, _, _ = H._both_ways(x, mask, net)
    want = H._sigmoid(states @ net["out"] + net["base"])
    for r, got in enumerate(H.label(pages, net)):
        assert np.abs(got - want[: len(each[r]), r]).max() < 1e-4


def test_odd_tables(spark):
    rows = [(1, "u", "<article><h1>Title of it</h1><p>Words of a text.</p></article>", "x", "y", 3), (None, None, None, None, None, None), (2, "u", "", "x", "y", 3), (2, "u", "", "x", "y", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, rid string, n_chars int")
    got = H.extract(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "Title of it\nWords of a text.", 28), ("2", "", 0), ("2", "", 0), ("None", "", 0)]
    assert H.extract(df.where("false")).count() == 0
