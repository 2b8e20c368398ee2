"""What of a page is shown: inherited visibility and closed details; whole tables of odd rows."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import html


@pytest.mark.parametrize(
    "markup, text",
    [
        ("<p style='visibility:hidden'>a<span style='visibility:visible'>b</span></p>", "b"),
        ("<div style='visibility: hidden'>no<p>no<b style='VISIBILITY:Visible'>yes<i style='visibility:collapse'>no</i>!</b></p></div>ok", "yes!\n\nok"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
        ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
        ("<table><tr><td style='visibility:hidden'>abc<td>d<tr><td>x<td>y</table>", "  | d\nx | y"),
        ("<svg><g visibility='hidden'><text>no</text><text visibility='visible'>yes</text></g></svg>", "yes"),
        ("<p title='visibility:hidden'>shown</p><p data-x='visibility'>too</p>", "shown\n\ntoo"),
        ("<div style='backface-visibility:hidden'>shown</div>", "shown"),
        ("<div style='visibility:hidden'><input type=submit value=no><textarea>no</textarea></div>", ""),
        ("<div style='display:none'><b style='visibility:visible'>no</b></div>", ""),
        ("<details><summary>S</summary>hid<p>hid</details>out", "S\nout"),
        ("<details open><summary>S</summary>seen</details>", "S\nseen"),
        ("<details>no<p>no<summary>in a paragraph</summary></details>", "in a paragraph"),
        ("<details><div>no</div><summary>one</summary><summary>two</summary></details>", "one"),
        ("<details open>a<details><summary>b</summary>no</details>c</details>", "a\nb\nc"),
        ("<details class='open'><summary>s <b>t</b></summary>no</details>", "s t"),
    ],
)
def test_visibility(markup, text):
    assert html.render(markup) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<details>", "<details open>", "</details>", "<summary>", "</summary>", "<p style='visibility:hidden'>", "<b style='visibility:visible'>", "</p>", "</b>", "<ul>", "<li>", "</ul>", "<table>", "<td>", "</table>", "<svg>", "</svg>", "x", " "]), max_size=30).map("".join))
def test_never_fails(markup):
    assert isinstance(html.render(markup), str)


def test_long_markup_takes_seconds():
    began = time.process_time()
    for part in ("<details><summary>x</summary>y", "<p style='visibility:hidden'><b style='visibility:visible'>x", "<details><p>x"):
        html.render(part * 40_000)
    assert time.process_time() - began < 30


def test_tables_of_odd_rows(spark):
    """Nulls, empty, repeated and very long rows, a column of the output's name, and no rows."""
    long = "<p>word</p>" * 60_000
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<b>x</b>"), (4, long), (5, "  \n "), (6, "<" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(7)).withColumn("lines", F.lit("z"))
    got = html.extract(pages)
    assert got.columns == ["page_id", "html", "text", "lines"]
    assert sorted(((r.page_id or 0, r.text) for r in got.collect())) == sorted((k or 0, html.render(m)) for k, m in rows)
    assert {r.page_id: r.text for r in got.collect()}[4].count("word") == 60_000
    assert html.extract(pages.limit(0)).count() == 0
