"""Rendered pages against their expected layout, and whole tables against a plain reading."""

import html
import re

import pytest

from qualispark.llm.html_text import extract, visible_text

CASES = [
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<p> a  <b>b\n c</b>d</p>e", "a b cd\n\ne"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<head><title>no</title><style>p{}</style></head><body>yes<script>no()</script></body>", "yes"),
    ("<div style='color:red; DISPLAY : none'>no<p>no</div><p hidden>no</p><p>yes", "yes"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<p>c</ol>x", "9. a\n10. b\n\n    c\n\nx"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><caption>t</caption><thead><tr><th>h<th>i</thead><tbody><tr><td>j<br>k<td>l</table>", "t\nh  i\nj  l\nk"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
    ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<details><summary>s</summary>no<p>no</details><details open><summary>s</summary>yes</details>", "s\n\ns\nyes"),
    ("<h1>a<h2>b</h2>c", "a\n\nb\n\nc"),
    ("<a href=x>l<a href=y>m</a>", "lm"),
    ("x<![odd]>y<!-- <p>no -->z</nothing></p>w", "xyz\n\nw"),
    ("<td>a</td><tr><td>b", "a\nb"),
    ("<table>stray<tr><td>a</table>", "stray\n\na"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_layout(page, want):
    assert visible_text(page) == want


def test_depth_and_length():
    deep = "<div><b>" * 20_000 + "core" + "</b></div>" * 20_000
    assert visible_text(deep) == "core"
    assert len(visible_text("<p>word " * 50_000).split()) == 50_000


def plain(page):
    """Words left once comments, hidden elements and tags go."""
    page = re.sub(r"<!--.*?-->|<!doctype[^>]*>", " ", page, flags=re.S | re.I)
    page = re.sub(r"<(head|script|style|template)\b.*?</\1\s*>", " ", page, flags=re.S | re.I)
    page = re.sub(r"</?(?:b|i|em|strong|a|span|code|u|small|sup|sub)\b[^>]*>", "", page, flags=re.I)
    return sorted(html.unescape(re.sub(r"<[^>]*>", " ", page)).split())


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        mine = re.sub(r"^ *(?:- )+", "", got[r["page_id"]], flags=re.M).split()
        assert sorted(mine) == plain(r["html"])


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "<p>a", "x"), (1, None, None, "x"), (2, "u", "", None)]
    got = sorted(((r["page_id"] or 0), r["text"], r["n_lines"]) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_many_open_tags_take_linear_time():
    import time


    began = time.perf_counter()
    assert visible_text("<b>x" * 20_000).count("x") == 20_000
    assert time.perf_counter() - began < 5
