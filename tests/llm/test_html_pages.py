"""Visibility rules, spanning cells, open items and hostile nesting of the HTML layout."""

import pytest

from plaint.llm import html


@pytest.mark.parametrize("page, text", [
    ("<!-- a --!>y", "y"),
    ("<!--->z", "z"),
    ("<!-->z<!-- - -- -->a", "za"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d", "b\nd"),
    ("<div style='display:none'>a<b style='display:block'>b</b></div>d", "d"),
    ("<style>.x{display:none} /* .y{display:none} */ @media print{.z{display:none}} p#q.r, b {visibility:hidden}</style>"
     "<p class='a x'>no</p><p class=y>yes</p><p class=z>too</p><p id=q class='r s'>no<b style='visibility:visible'>in</b></p>", "yes\n\ntoo\n\nin"),
    ("<style>p{display:none}p.on{display:block}#a{display:none!important}</style><p>1<p class=on>2<p class=on id=a style='display:block'>3", "2"),
    ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here  z\na  b            c"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<ul><li>a<blockquote><li>b</blockquote>c<li>d</ul>e", "- a\n\n    - b\n\n  c\n- d\n\ne"),
    ("<ul><li>a<ul><li>b</ul>c</ul>d", "- a\n  - b\n  c\n\nd"),
    ("<dl><dt>t<dd>x<dd>y</dl>z", "t\n  x\n  y\n\nz"),
    ("<dl><dt>t<dd>x<dl><dt>u<dd>v</dl>w</dl>", "t\n  x\n\n  u\n    v\n\n  w"),
])
def test_visibility_spans_and_items(page, text):
    assert html.to_text(page) == text


@pytest.mark.parametrize("page", [
    "<ul><li>x" * 60_000,
    "<blockquote>x" * 40_000,
    "<table><tr><td>x<td>" * 25_000,
    "<table><tr><td>" + "long " * 60_000 + "<td>x" + "<tr><td>a<td>b" * 20_000,
    "<table><tr>" + "<td colspan=1000 rowspan=2>x" * 20_000 + "<tr><td>y",
    "<style>" + "".join(f".c{i}{{display:none}}" for i in range(10_000)) + "</style>" + "<p class='c1 c2'>x<p class=d>y" * 10_000,
])
def test_text_stays_in_proportion_to_the_page(page):
    text = html.to_text(page)
    shown = sum(c in "xylongab" for c in text)
    assert shown >= page.count(">y") + page.count("long ") and len(text) <= 20 * len(page)


def test_rows_that_repeat_or_lack_values(spark):
    page = "<p>a</p><table><tr><td>b<td>c</table>"
    rows = [(1, page, "x", 5), (1, page, "y", 6), (None, page, None, None), (2, None, "x", 1), (3, "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.n_chars, r.n_lines, r.text) for r in html.extract(pages).collect())
    whole = (len("a\n\nb  c"), 3, "a\n\nb  c")
    assert got == [(0, *whole), (1, *whole), (1, *whole), (2, 0, 0, ""), (3, 0, 0, "")]
    assert html.extract(pages.limit(0)).collect() == []
