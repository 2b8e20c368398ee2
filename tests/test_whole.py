"""Queries read whole tables."""

import duckdb

from folioscan.plans import catalogue, duck, library  # noqa: F401 (library registers its queries)

MEDIUM = "/root/testdata/sf0.01"


def rows_of(table, sql):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{MEDIUM}/{table}.parquet'")
    return con.sql(sql).fetchall()


def test_snapshot_reads_every_chunk(spark):
    """More than one chunk, and no document left out."""
    got = catalogue.QUERIES["snapshot_round_trip"](spark, MEDIUM).collect()
    want = rows_of("documents", f"with {duck.DOCS} select doc_id, id, title, abstract from docs")
    assert len({r.chunk for r in got}) > 1
    assert sorted((r.doc_id, r.id, r.title, r.abstract) for r in got) == sorted(want)


def test_notes_of_every_turn_are_searched(spark):
    """Turns after the first two give hits, and every turn that holds the query is one."""
    got = {r.paper_id for r in catalogue.QUERIES["notes_search"](spark, MEDIUM).collect()}
    want = rows_of("conversations", "select conv_id || '-' || turn from conversations where contains(lower(text), 'tion')")
    assert got == {x for x, in want} and any(int(x.split("-")[1]) > 1 for x in got)


def test_requests_are_debounced(spark):
    got = catalogue.QUERIES["debounced_saves"](spark, MEDIUM).count()
    assert 0 < got < 0.9 * rows_of("events", "select count(*) from events")[0][0]


def test_identifiers_that_repeat_beyond_five_digits(spark, tmp_path):
    """Queries on numbers differ from their SQL only in what its order leaves open: with that order whole they are equal."""
    order, path = "order by published desc, id desc", tmp_path / "documents.parquet"
    numbers = [k for x in range(10000, 30000) for d in range(10) if (9 * x + d) % 3500 == 0 for k in (x, 10 * x + d)]
    con = duckdb.connect()
    con.execute(f"copy (select {numbers}[doc_id + 1] as doc_id, * exclude doc_id from '{MEDIUM}/documents.parquet' where doc_id < {len(numbers)}) to '{path}' (format parquet)")
    con.execute(f"create view documents as select * from '{path}'")
    groups = con.execute(f"with {duck.DOCS} select published, id, count(*) from docs group by all having count(*) > 1").fetchall()
    assert len(groups) > 30
    for name in ("doc_numbering", "browse_oldest", "postings", "postings_delta", "postings_decoded"):
        sql = catalogue.ORACLES[name]
        assert sql.count(order) == 1
        want = con.execute(sql.replace(order, f"{order}, source_id desc")).fetchall()
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want), name


def test_other_queries_where_identifiers_repeat(spark, tmp_path):
    """As above: windows of abstracts, snapshots and related papers."""
    order, path = "order by published desc, id desc", tmp_path / "documents.parquet"
    numbers = [k for x in range(10000, 30000) for d in range(10) if (9 * x + d) % 3500 == 0 for k in (x, 10 * x + d)]
    con = duckdb.connect()
    con.execute(f"copy (select {numbers}[doc_id + 1] as doc_id, * exclude doc_id from '{MEDIUM}/documents.parquet' where doc_id < {len(numbers)}) to '{path}' (format parquet)")
    con.execute(f"create view documents as select * from '{path}'")
    for name in ("abstract_window", "snapshot_round_trip", "related_terms_all", "related_papers_all"):
        sql = catalogue.ORACLES[name]
        assert sql.count(order) == 1
        want = con.execute(sql.replace(order, f"{order}, source_id desc")).fetchall()
        assert sorted(map(repr, map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(repr, want)), name
