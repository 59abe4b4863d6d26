from __future__ import annotations

import pytest

from flowloom.llm import queries
from flowloom.llm.html_text import page_texts, visible_text

PAGES = [
    ("", ""),
    ("plain &amp; a < b\n text", "plain & a < b text"),
    ("<title>t</title><p>one<p>two <b>b</b>old", "one\n\ntwo bold"),
    ("<div>a</div><div>b<br>c</div>d", "a\nb\nc\nd"),
    ("a<br><br>b", "a\n\nb"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>w", "- x\n- y\n  - z\n\nw"),
    ("<ol start=9><li>a<li value=3>b<li>c</ol>", "9. a\n3. b\n4. c"),
    ("<table><tr><th>id<th>name<tr><td>1<td>Ann<tr><td>22<td>B</table>", "id | name\n1  | Ann\n22 | B"),
    (
        "<table><caption>C</caption><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide</table>",
        "C\na | b\n  | c\nwide",
    ),
    ("<table><tr><td>1<br>2<td>x</table>", "1 | x\n2"),
    ("<table><td>in<table><tr><td>p<td>q</table></table>", "in\n\np | q"),
    ("<pre>\n a\n  b\n</pre>c", " a\n  b\n\nc"),
    ("<p hidden>x</p><p style='DISPLAY : none'>y<script>1<2</script><style>p{}</style>", ""),
    ("<div style='visibility:hidden'>a<i style='visibility: visible'>b</i></div>", "b"),
    ("<script>if (a</b) x</script>seen<!-- no --><noscript>n</noscript>", "seen"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<select><option>a<option selected>b</select> <input value=v><input type=hidden value=h>", "b\nv"),
    ("<blockquote>a<p>b</blockquote>", "> a\n>\n> b"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<p>a</div>b</p>c", "ab\n\nc"),
    ("<b>x<i>y</b>z</i>", "xyz"),
    ("<a href='x>y'>link</a><img alt=no>", "link"),
    ("x<hr>y", "x\n\n---\n\ny"),
    ("<script>never closed <p>x", ""),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_layout(source, text):
    assert visible_text(source) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 30_000 + "x") == "x"
    assert visible_text("<li>" * 3000 + "x").endswith("x")
    assert len(visible_text("word " * 300_000)) == 5 * 300_000 - 1
    wide = "<table>" + "<tr><td>" + "x" * 5000 + "<td>y" + "<tr><td>a<td>b" * 500 + "</table>"
    assert len(visible_text(wide)) < 60_000


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (None, None, "b"), (3, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 AS key", "'no' AS text")
    got = sorted((tuple(r) for r in page_texts(pages).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "a"), (2, ""), (None, "b"), (3, "")], key=repr)
    assert page_texts(pages.limit(0)).count() == 0


def test_query_covers_all_pages(spark):
    rows = queries.op1_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and all(r.text and "<" not in r.text for r in rows)
