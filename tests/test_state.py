import json
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import papers as pp
from folioscan.operators import state as st
from folioscan.operators import structure as sr
from folioscan.sources import feeds
from folioscan.streaming import streams


def test_merge_rules(spark):
    kinds = "id string, v string, updated_at long, deleted boolean, seq int"
    local = spark.createDataFrame([("a", "L", 5, False, 0), ("b", "L", 4, False, 0), ("c", "L1", 3, False, 0), ("c", "L2", 3, False, 1)], kinds)
    remote = spark.createDataFrame([("a", "R", 5, False, 0), ("b", "R", 9, True, 0), ("d", "R1", 9, False, 0), ("d", "R2", 1, False, 1)], kinds)
    got = {r.id: r.v for r in st.merge(local, remote, "id", "seq").collect()}
    assert got == {"a": "L", "b": "R", "c": "L2", "d": "R2"}
    day = 24 * 3600 * 1000
    kept = st.prune(spark.createDataFrame([("x", 0, True), ("y", 1, True), ("z", 0, False)], "id string, updated_at long, deleted boolean"), 90 * day)
    assert sorted(r.id for r in kept.collect()) == ["y", "z"]


def test_documents_and_collections(spark):
    notes = spark.createDataFrame([("p", "n", 1, False)], "paper_id string, body string, updated_at long, deleted boolean")
    out = st.merge_documents({"notes": notes, "updated_at": 3}, {"settings": {"updated_at": 2}})
    assert st.record_count(out) == 1 and out["settings"] == {"updated_at": 2} and out["updated_at"] == 3
    cols = spark.createDataFrame([("c1", "x", 1, False)], "id string, name string, updated_at long, deleted boolean")
    entries = spark.createDataFrame([("p", ["c1", "c2"], 1), ("q", ["c2"], 1)], "paper_id string, collection_ids array<string>, updated_at long")
    marked, freed = st.delete_collection(cols, entries, "c1", 9)
    assert marked.first().deleted and {(r.paper_id, tuple(r.collection_ids), r.updated_at) for r in freed.collect()} == {("p", ("c2",), 9), ("q", ("c2",), 1)}


def test_collections_made_renamed_and_listed(spark):
    cols = spark.createDataFrame([("a", "x", 0, 1, 1, True), ("b", "y", 1, 1, 1, False)], "id string, name string, order long, created_at long, updated_at long, deleted boolean")
    made = st.create_collection(cols, "c", "  ", "red", 9)
    assert [(r.id, r.name, r.order, r.color) for r in st.collections_listed(made).collect()] == [("b", "y", 1, None), ("c", "Untitled collection", 1, "red")]
    assert {r.id: (r.name, r.updated_at) for r in st.rename_collection(made, "b", " z ", 10).collect()} == {"a": ("x", 1), "b": ("z", 10), "c": ("Untitled collection", 9)}
    assert {r.id: r.name for r in st.rename_collection(cols, "b", " ", 10).collect()}["b"] == "y"
    marks = spark.createDataFrame([("1", "p", 5, None), ("2", "p", 3, False), ("3", "q", 4, False), ("4", "p", 9, True)], "id string, paper_id string, created_at long, deleted boolean")
    assert [r.id for r in st.highlights_listed(marks).collect()] == ["1", "3", "2"]
    assert [r.id for r in st.highlights_listed(marks, "p").collect()] == ["2", "1"]
    assert [r.id for r in st.searches_listed(marks).collect()] == ["1", "3", "2"]


def test_progress_notes_and_imports(spark):
    entries = spark.createDataFrame([("p", "unread", 1, None), ("q", "unread", 1, True), ("r", "finished", 1, False)], "paper_id string, status string, updated_at long, deleted boolean")
    moves = spark.createDataFrame([("p", 0.5, 3, 1), ("p", 0.1, 3, 2), ("q", 0.99, None, 3), ("r", 0.3, None, 4), ("new", 0.99, None, 5), ("r", None, None, 0)], "paper_id string, percent double, total int, seq long")
    none = spark.createDataFrame([], "paper_id string, percent double, total int, updated_at long, deleted boolean")
    progress, moved = st.save_progress(none, entries, moves, 7)
    assert {r.paper_id: (r.status, r.updated_at) for r in moved.collect()} == {"p": ("reading", 7), "q": ("unread", 1), "r": ("finished", 1)}
    assert {r.paper_id: r.percent for r in progress.collect()} == {"p": 0.1, "q": 0.99, "r": 0.3, "new": 0.99}
    papers = spark.createDataFrame([("p", "P")], "id string, title string")
    listed = st.library_papers(entries.withColumn("added_at", F.col("updated_at")), papers, progress, "title")
    assert [(r.paper_id, r.title, r.percent) for r in listed.collect()] == [("p", "P", 0.1), ("r", None, 0.3)]
    assert st.library_papers(entries.withColumn("added_at", F.col("updated_at")), papers, progress, "title", cards=True).count() == 1
    notes = spark.createDataFrame([("p", "n", 1, False), ("q", "m", 1, True)], "paper_id string, body string, updated_at long, deleted boolean")
    changes = spark.createDataFrame([("p", " \n"[:1]), ("q", "again"), ("r", None), ("s", "new")], "paper_id string, body string")
    assert {r.paper_id: (r.body, r.deleted, r.updated_at) for r in st.save_notes(notes, changes, 9).collect()} == {"p": ("", True, 9), "q": ("again", False, 9), "s": ("new", False, 9)}
    schemas = {name: f"{key} string, updated_at long" for name, key in st.TABLES.items()}
    schemas["notes"] = notes.schema
    older = spark.createDataFrame([("p", "old", 0, False)], notes.schema)
    out = st.import_document(spark, {"notes": notes, "settings": {"a": 1}, "updated_at": 4}, {"notes": older, "settings": {"a": 2}}, schemas)
    assert {r.paper_id: r.body for r in out["notes"].collect()} == {"p": "old", "q": "m"}
    assert out["settings"] == {"a": 1} and out["updated_at"] == 4 and out["library"].count() == 0
    empty = st.normalise(spark, None, schemas)
    assert empty["updated_at"] == 0 and empty["settings"] is None and st.record_count(empty) == 0


def test_units_done_and_rated(spark):
    kinds = "paper_id string, key string, label string, ordinal int, done boolean, rating string, completed_at long, updated_at long, deleted boolean, id string"
    states = spark.createDataFrame([("p", "a", "A", 0, True, None, 1, 1, False, "p#a"), ("p", "b", "B", 1, True, "lost", 1, 1, True, "p#b")], kinds)
    units = spark.createDataFrame([("p", "a", "A", 0), ("p", "b", "B", 1), ("p", "c", "C", 2)], "paper_id string, key string, label string, ordinal int")
    done = {r.key: r.completed_at for r in st.mark_done(states, units, 7).collect()}
    assert done == {"b": 7, "c": 7}
    rated = st.rate(states, units.withColumn("rating", F.lit("fuzzy")), 7)
    assert {r.key: r.completed_at for r in rated.collect()} == {"a": 1, "b": 1, "c": 7}
    assert st.revisits(rated).count() == 3


def test_toggle_and_notes(spark):
    kinds = "paper_id string, status string, starred boolean, collection_ids array<string>, tags array<string>, added_at long, updated_at long, deleted boolean"
    entries = spark.createDataFrame([("p", "reading", True, [], ["t"], 1, 1, False), ("q", "finished", True, [], [], 1, 1, True)], kinds)
    got = {r.paper_id: (r.deleted, r.status) for r in st.toggle(entries, spark.createDataFrame([("p",), ("q",), ("r",)], "paper_id string"), 5).collect()}
    assert got == {"p": (True, "reading"), "q": (False, "unread"), "r": (False, "unread")}
    notes = spark.createDataFrame([("p", "About Nets", False), ("q", "nets", True)], "paper_id string, body string, deleted boolean")
    marks = spark.createDataFrame([("p", "deep nets", "why", False), ("q", "nets", None, False)], "paper_id string, exact string, note string, deleted boolean")
    assert sorted(r.body for r in st.search_notes(notes, marks, " NETS ").collect()) == sorted(["About Nets", 'why — "deep nets"', '"nets"'])
    assert st.search_notes(notes, marks, " ").count() == 0


def test_debounce(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 100, 800, 1500, 5000)], "key string, at long")
    # 0..1500 are one burst: it saves after 1200, as no pause came; the request at 1500 saves 900 later.
    assert sorted(r.saved_at for r in st.save_times(rows).collect()) == [1200, 2400, 5900]


def test_compaction_picks_before_it_filters(spark):
    log = spark.createDataFrame([("a", 1, False, ["cs.LG"]), ("a", 2, True, []), ("b", 1, False, ["cs.LG"]), ("b", 2, False, ["q"]), ("c", 1, None, ["cs.LG"])], "id string, line long, deleted boolean, categories array<string>")
    assert [r.id for r in pp.compact(log, ["line"], ["cs.LG"]).collect()] == ["c"]


def test_feed_and_log(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<r><record><header><identifier>oai:x:1</identifier><datestamp>2024-01-01</datestamp></header><metadata><arXiv><id>1</id><created>2023-01-01</created><title>A\n &amp; B</title><categories>cs.AI  cs.LG</categories><abstract> t </abstract><authors><author><keyname>Lee</keyname><forenames>Ann</forenames></author><author><keyname>Bo</keyname></author></authors></arXiv></metadata></record><record><header status='deleted'><identifier>oai:x:2</identifier><datestamp>2024-01-02</datestamp></header></record></r>")
    got = {r.id: r for r in feeds.read_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert (got["1"].title, got["1"].authors, got["1"].categories, got["1"].abstract) == ("A & B", ["Ann Lee", "Bo"], ["cs.AI", "cs.LG"], "t")
    assert got["2"].deleted
    (tmp_path / "log.jsonl").write_text(json.dumps({"id": "1", "title": "x"}) + "\n\n{\"id\": \"2\", \"ti")
    assert [r.id for r in feeds.read_records(spark, str(tmp_path / "log.jsonl")).collect()] == ["1"]


def test_anchors(spark):
    rows = spark.createDataFrame([("one two three two", "two", "three ", ""), ("one two", "two", "gone ", "x"), ("abc", "zz", "", "")], "t string, e string, p string, s string")
    at = [r[0] for r in rows.select(sr.locate(F.col("t"), F.struct(F.col("e").alias("exact"), F.col("p").alias("prefix"), F.col("s").alias("suffix")))).collect()]
    assert at == [14, 4, None]


def test_streamed_debounce(spark, tmp_path):
    """Timers save what is due; a flush saves at once, and nothing where nothing is unsaved."""
    src, rows = tmp_path / "in", [("k", 1000, False), ("k", 1500, False), ("k", 100_000, False), ("f", 1000, False), ("f", 1300, True), ("f", 1400, True), ("z", 500_000, False)]
    spark.createDataFrame(rows, "key string, ms long, flush boolean").select("key", F.timestamp_millis("ms").alias("at"), "flush").coalesce(1).write.parquet(str(src))
    for kind in ("key string, at timestamp", "key string, at timestamp, flush boolean"):
        name = f"saves{len(kind)}"
        stream = spark.readStream.schema(kind).parquet(str(src))
        q = streams.debounced(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.key, r.saved_at) for r in spark.table(name).collect()}
        assert ("k", 2200) in got
        assert (("f", 1300) in got) == ("flush" in kind) and ("f", 1400) not in got


@pytest.mark.parametrize("quiet, most", [(900, 1200), (5, 20), (10, 10), (30, 20)])
def test_saves_are_those_of_a_fold(spark, quiet, most):
    """One key has nearly all requests, in bursts much longer than the longest wait."""
    r = random.Random(quiet)
    rows = [("hot", r.randrange(4000) * (1 + quiet // 8)) for _ in range(1500)] + [("a", 5), ("a", 5), ("b", 7), (None, 3), ("c", None)] + [(f"k{k % 20}", r.randrange(3000)) for k in range(200)]
    want = set()
    for key in {k for k, t in rows if k is not None}:
        first = last = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if first is not None and min(last + quiet, first + most) <= t:
                want.add((key, min(last + quiet, first + most)))
                first = None
            first, last = t if first is None else first, t
        if first is not None:
            want.add((key, min(last + quiet, first + most)))
    got = [tuple(x) for x in st.save_times(spark.createDataFrame(rows, "key string, at long"), quiet=quiet, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_exports(spark, tmp_path):
    from folioscan.sources import exports

    notes = spark.createDataFrame([("1", "n", 4, True)], "paper_id string, body string, updated_at long, deleted boolean")
    exports.write_state({"notes": notes, "updated_at": 4}, str(tmp_path / "state"))
    back = exports.read_state(spark, str(tmp_path / "state"), {"notes": notes.schema, "library": notes.schema})
    assert back["notes"].collect() == notes.collect() and back["updated_at"] == 4 and "library" not in back
    papers = spark.createDataFrame([("1", "On Deep Nets", ["Ann Lee"], "2024-01-05", ["cs.LG"])], "id string, title string, authors array<string>, published string, categories array<string>")
    entries = spark.createDataFrame([("1", False), ("2", False)], "paper_id string, deleted boolean")
    assert exports.citations(entries, papers).first().entry.startswith("@misc{lee2024deep,")
    exports.write_citations(entries, papers, str(tmp_path / "bib"))
    manifest = spark.createDataFrame([(5,)], "built_at long")
    assert not exports.has_moved(manifest, manifest) and exports.has_moved(manifest, manifest.withColumn("built_at", F.lit(6))) and exports.has_moved(None, manifest)


def test_addresses_that_run_code(spark):
    page = "<div class='ltx_page_main'><a href=' java\tscript:x()'>a</a><a href='https://x.org/'>b</a></div>"
    doc = sr.structure(spark.createDataFrame([(page, "https://y.org/")], "html string, url string")).first().doc
    assert "script:" not in doc.html and [x.href for x in doc.links] == ["https://x.org/"]
