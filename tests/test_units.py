"""Document structure of hand-written papers, against results worked out by hand."""

import random
import time

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.dom import parse
from folioscan.operators import structure as sr
from folioscan.plans.catalogue import values

# Worked out by hand from `paper_pages`: a heading's text runs into the paragraph's first word, and
# short neighbours are merged.
UNITS = values(
    (1, "1-introduction", "S1", "S1", "1 Introduction", 1, 397, 2, False, 0, 0),
    (1, "2-method", "S2", "S2.SS1", "2 Method", 1, 100, 1, False, 0, 1),
    (1, "2-1-data", "S2.SS1", "S2.SS1", "2.1 Data", 2, 400, 2, False, 0, 2),
    (1, "2-2-data", "S2.SS2", "S2.SS2", "2.2 Data", 2, 500, 3, False, 0, 3),
    (1, "3-short", "S3", "S4", "3 Short", 1, 31, 1, False, 1, 4),
    (1, "a-proofs", "A1", "A1", "A Proofs", 1, 720, 4, True, 0, 5),
    names="n, key, element_id, end_element_id, label, level, words, minutes, appendix, merged, ordinal",
)
SECTION = "<section id='{0}' class='ltx_section'><h2 class='ltx_title ltx_title_section'><span class='ltx_tag'>{1}</span>{2}</h2><p>{3}</p>{4}</section>"


def paper_pages(spark: SparkSession) -> DataFrame:
    """A few hand-written papers with sections, an appendix and links."""
    prose = lambda n: " ".join(["word"] * n)
    sub = SECTION.format("S2.SS1", "2.1", "Data", prose(400), "") + SECTION.format("S2.SS2", "2.2", "Data", prose(500), "")
    body = SECTION.format("S1", "1", "Introduction", prose(397), "") + SECTION.format("S2", "2", "Method", prose(100), sub) + SECTION.format("S3", "3", "Short", prose(10), "") + SECTION.format("S4", "4", "Also short", prose(20), "")
    appendix = "<section id='A1' class='ltx_appendix'><h2 class='ltx_title ltx_title_appendix'><span class='ltx_tag'>A</span>Proofs</h2><p>" + prose(720) + "</p></section>"
    links = "<a href='#S1'>in</a><a href='2608.1v1/fig.html'>out</a><img src='x.png'><img src='/static/logo.png'>"
    page = f"<html><body><nav>menu</nav><div class='ltx_page_main'><div class='ltx_abstract'><h6>Abstract</h6><p> What we did. </p></div>{body}{appendix}{links}</div></body></html>"
    return spark.createDataFrame([(1, "https://arxiv.org/html/2608.1", page), (2, "https://arxiv.org/html/none", "<html><body>No HTML</body></html>")], "n int, url string, html string")


def test_units_contents_and_abstract(spark):
    found = sr.structure(paper_pages(spark))
    units = found.select("n", F.explode("doc.units").alias("u")).select("n", "u.*")
    want = duckdb.sql(UNITS)
    assert sorted(map(tuple, units.select(*want.columns).collect())) == sorted(want.fetchall())
    toc = found.select("n", F.explode("doc.toc").alias("t")).select("n", "t.id", "t.label", "t.level").collect()
    assert [tuple(r) for r in toc] == [(1, "S1", "1Introduction", 1), (1, "S2", "2Method", 1), (1, "S2.SS1", "2.1Data", 1), (1, "S2.SS2", "2.2Data", 1), (1, "S3", "3Short", 1), (1, "S4", "4Also short", 1)]
    rows = found.select("n", F.col("doc").isNotNull().alias("available"), "doc.abstract").collect()
    assert sorted(map(tuple, rows)) == [(1, True, "What we did."), (2, False, None)]


def made(r, depth=0):
    """Random nested sections, appendices and other elements, with text that runs across their edges."""
    out = []
    for _ in range(r.randrange(4)):
        out.append(r.choice(["word", " ", "a b", " c", "d ", "", "x y z "]))
        kind = r.randrange(6)
        inner = made(r, depth + 1) if depth < 5 else ""
        if kind < 3:
            out.append(f"<section id='s{r.randrange(10**9)}' class='{r.choice(['', '', 'ltx_appendix'])}'>{r.choice(['', '<h2>Head</h2>', '<h3><span class=ltx_tag>1</span>Own</h3>'])}{inner}</section>")
        elif kind == 3:
            out.append(f"<div class='{r.choice(['', 'ltx_appendix'])}'>{inner}</div>")
        else:
            out.append(f"<b>{inner}</b>")
    return "".join(out)


def slow_sections(root):
    """The same from each section's own text and ancestors."""
    appendix = lambda e: sr.has(e, "ltx_appendix")
    every = [e for e in root.walk() if sr.is_section(e)]
    count = lambda e, skip: len(e.text(lambda x: " " if skip(x) else None).split())
    for s in every:
        around, inside = [x for x in s.up() if x is not s], [x for x in every if any(y is s for y in x.up()) and x is not s]
        outermost = appendix(s) and not any(appendix(x) for x in around)
        hidden = any(appendix(x) for x in [s, *around])
        words = count(s, lambda x: False) if outermost else count(s, appendix)
        yield (s.id, min(3, 1 + sum(map(sr.is_section, around))), hidden, outermost, None if hidden and not outermost else words, None if hidden else count(s, lambda x: appendix(x) or sr.is_section(x)), inside[0].id if inside else None, inside[-1].id if inside else None)


def test_sections_of_random_pages():
    r = random.Random(2)
    for _ in range(1500):
        root = parse(made(r))
        got = [(s["id"], s["level"], s["appendix"], s["outermost"], None if s["appendix"] and not s["outermost"] else s["words"], None if s["appendix"] else s["own"], s["first"], s["last"]) for s in sr.sections(root)]
        assert got == list(slow_sections(root))


@pytest.mark.parametrize("page", ["<section id='s'><p>word " * 20_000 + "</section>" * 20_000, "".join(f"<section id='s{k}' class='ltx_section'><h2>Head {k % 9}</h2><p>{'word ' * 100}</p></section><script>x</script>" for k in range(9_000))])
def test_large_pages_take_seconds(spark, page):
    """Megabytes of deep and of many sections."""
    rows = spark.createDataFrame([(f"<div class='ltx_page_main'>{page}</div>", "")], "html string, url string")
    began = time.time()
    assert sr.structure(rows).select(F.size("doc.units").alias("n")).first().n > 0
    assert time.time() - began < 60


def test_repeated_keys_and_odd_pages(spark):
    body = "".join(f"<section id='s{k}'><h2>{h}</h2><p>{'word ' * 400}</p></section>" for k, h in enumerate(["Data", "", "Data", "Ünü", "???", "data"]))
    rows = spark.createDataFrame([(1, f"<div class='ltx_page_main'>{body}</div>", None), (2, None, None), (3, "", ""), (4, "<div class='ltx_page_main'></div>", None), (1, f"<div class='ltx_page_main'>{body}</div>", None)], "n int, html string, url string").withColumn("doc", F.lit(0)).withColumn("key", F.lit("k"))
    got = sr.structure(rows).select("n", "doc.units.key", F.col("doc").isNull().alias("none")).collect()
    assert sorted([(r.n, r.key, r.none) for r in got], key=str) == sorted([(1, ["data", "s1", "data-3", "n", "unit-5", "data-6"], False)] * 2 + [(2, None, True), (3, None, True), (4, [], False)], key=str)
    assert sr.structure(rows.limit(0)).count() == 0


def test_positions_reach_units(spark):
    """Before the first unit, at an end exactly, in the last, at the page's end and beyond; a paper without units."""
    starts = spark.createDataFrame([("p", 0, "a", 3), ("p", 1, "b", 600), ("p", 2, "c", 600), ("p", 3, "d", 2000), ("q", 0, "z", 0)], "paper string, ordinal int, key string, start long")
    ends = spark.createDataFrame([("p", 2100), ("q", 5), ("r", 9)], "paper string, end long")
    at = [("p", 0), ("p", 3), ("p", 599), ("p", 600), ("p", 1999), ("p", 2099), ("p", 2100), ("p", 9999), ("q", 4), ("q", 5), ("r", 1)]
    got = {(r.paper, r.position): (r.key, r.done, r.total) for r in sr.reached(spark.createDataFrame(at, "paper string, position long"), starts, ends).collect()}
    assert got == {("p", 0): (None, 0, 4), ("p", 3): ("a", 0, 4), ("p", 599): ("a", 0, 4), ("p", 600): ("c", 2, 4), ("p", 1999): ("c", 2, 4), ("p", 2099): ("d", 3, 4), ("p", 2100): ("d", 4, 4), ("p", 9999): ("d", 4, 4), ("q", 4): ("z", 0, 1), ("q", 5): ("z", 1, 1)}


def test_units_alone_are_those_of_the_whole_structure(spark):
    from folioscan.operators import structure as sr
    from folioscan.plans.catalogue import text_pages

    from .conftest import SMALL

    pages = text_pages(spark, SMALL).filter("doc_id < 60").select("doc_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame([(-1, "", None), (-2, "", "<p>x</p>"), (-3, "", "<div class=ltx_page_main><nav><section id=a>b</section></nav></div>")], "doc_id long, url string, html string"))
    want = {r.doc_id: r.units for r in sr.structure(pages).select("doc_id", "doc.units").collect()}
    assert {r.doc_id: r.units for r in sr.reading_units(pages).select("doc_id", "units").collect()} == want
