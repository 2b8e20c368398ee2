"""Registered queries of the library, of documents of state, of feeds and logs, and their DuckDB SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from ..operators import papers as pp
from ..operators import state as st
from ..operators import structure as sr
from ..sources import exports, feeds
from ..storage import shared_dir
from . import duck
from .catalogue import SECTION_UNITS, SIDES, built, known_papers, query, sides, text_pages

NOW = 7


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries of the latest records: every second starred, in one of five collections, tagged by their type."""
    rows = st.latest(st.state_log(spark, sf_dir))
    collection = F.array(F.concat(F.lit("c"), (F.col("seq") % 5).cast("string")))
    return rows.select("paper_id", F.col("event_type").alias("status"), (F.col("seq") % 2 == 0).alias("starred"), collection.alias("collection_ids"), F.array("event_type").alias("tags"), F.col("updated_at").alias("added_at"), "updated_at", "deleted")


ENTRIES = f"{duck.WON}, entries as (select paper_id, event_type as status, seq % 2 = 0 as starred, 'c' || seq % 5 as collection, event_type as tag, updated_at as added_at, updated_at, deleted from won)"


@query(f"with {ENTRIES} select paper_id, status, collection, added_at from entries where not deleted and starred and collection = 'c2' and tag = 'view' and status = 'view'")
def library_tabs(spark, sf_dir):
    """The library by all four conditions at once."""
    found = st.library(entries(spark, sf_dir), status="view", starred=True, collection="c2", tag="view")
    return found.select("paper_id", "status", F.get("collection_ids", F.lit(0)).alias("collection"), "added_at")


@query(f"""with {ENTRIES}, asked as (select distinct 'u' || user_id * 2 as paper_id from events)
select coalesce(e.paper_id, a.paper_id) as paper_id, case when a.paper_id is null or not e.deleted then e.status else 'unread' end as status, case when a.paper_id is null or not e.deleted then e.added_at else {NOW} end as added_at,
 case when a.paper_id is null then e.updated_at else {NOW} end as updated_at, case when a.paper_id is null then e.deleted else coalesce(not e.deleted, false) end as deleted from entries e full join asked a on e.paper_id = a.paper_id""")
def bookmarks_toggled(spark, sf_dir):
    """Bookmarks of every second number switched, of papers with an entry, a deleted one, or none."""
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), (F.col("user_id") * 2).cast("string")).alias("paper_id"))
    return st.toggle(entries(spark, sf_dir), asked, NOW).select("paper_id", "status", F.col("added_at").cast("long").alias("added_at"), F.col("updated_at").cast("long").alias("updated_at"), "deleted")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.state_log(spark, sf_dir).groupBy(F.col("event_type").alias("id")).agg(F.count("seq").alias("order"), F.max("updated_at").alias("created_at"))
    return rows.select("id", F.upper("id").alias("name"), F.lit("yellow").alias("color"), "order", "created_at", F.col("created_at").alias("updated_at"), (F.col("id") == "error").alias("deleted"))


@query(f"""with {duck.LOG}, c as (select event_type as id, upper(event_type) as name, count(*) as place, max(updated_at) as updated_at, event_type = 'error' as deleted from log group by 1)
select id, case id when 'view' then 'Seen' else name end as name, place, case when id in ('view', 'click', 'signup') then {NOW} else updated_at end as updated_at, deleted or id = 'click' as deleted from c
 union all select 'new', 'Untitled collection', (select count(*) from c where not deleted), {NOW}, false""")
def collections_changed(spark, sf_dir):
    """A collection made without a name, two renamed, one of them to a blank, and one deleted."""
    rows = st.create_collection(collections(spark, sf_dir), "new", "  ", "green", NOW)
    for name, to in (("view", " Seen "), ("signup", " "), ("unknown", "x")):
        rows = st.rename_collection(rows, name, to, NOW)
    rows, _ = st.delete_collection(rows, entries(spark, sf_dir), "click", NOW)
    return rows.select("id", "name", F.col("order").alias("place"), F.col("updated_at").cast("long").alias("updated_at"), "deleted")


@query(f"with {ENTRIES} select paper_id, case collection when 'c3' then '' else collection end as collections, case collection when 'c3' then {NOW} else updated_at end as updated_at from entries")
def collection_detached(spark, sf_dir):
    """Entries once the collection that some are in is deleted."""
    _, freed = st.delete_collection(collections(spark, sf_dir), entries(spark, sf_dir), "c3", NOW)
    return freed.select("paper_id", F.array_join("collection_ids", ",").alias("collections"), F.col("updated_at").cast("long").alias("updated_at"))


def unit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit's state for every paper: done where the latest record is a view or a click."""
    rows, done = st.latest(st.state_log(spark, sf_dir)), F.col("event_type").isin("view", "click")
    return rows.select("paper_id", F.lit("intro").alias("key"), done.alias("done"), F.when(done, F.col("updated_at")).alias("completed_at"), F.lit(None).cast("string").alias("rating"), "deleted")


def all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"), F.lit("intro").alias("key"), F.lit("Intro").alias("label"), F.lit(0).alias("ordinal"), "user_id")


@query(f"with {duck.WON} select paper_id || '#intro' as id, true as done, {NOW} as completed_at from won where deleted or event_type not in ('view', 'click')")
def units_done(spark, sf_dir):
    """New rows for every paper's unit that isn't done yet; deleted ones begin anew."""
    rows = st.mark_done(unit_states(spark, sf_dir), all_units(spark, sf_dir).drop("user_id"), NOW)
    return rows.select("id", "done", F.col("completed_at").cast("int").alias("completed_at"))


@query(f"with {duck.WON} select paper_id || '#intro' as id, true as done, case cast(substr(paper_id, 2) as bigint) % 3 when 1 then 'fuzzy' when 2 then 'lost' end as rating, case when event_type in ('view', 'click') then updated_at else {NOW} end as completed_at from won")
def units_rated(spark, sf_dir):
    """Every paper's unit rated, or its rating taken back; a first completion keeps its time."""
    rating = F.when(F.col("user_id") % 3 == 1, "fuzzy").when(F.col("user_id") % 3 == 2, "lost")
    rows = st.rate(unit_states(spark, sf_dir), all_units(spark, sf_dir).withColumn("rating", rating).drop("user_id"), NOW)
    return rows.select("id", "done", "rating", "completed_at")


def documents_of_state(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """Both sides as documents of state: one has no notes, the other no progress."""
    local, remote = (rows.drop("is_local") for rows in sides(spark, sf_dir))
    return {"library": local, "progress": local, "updated_at": 5, "settings": {"updated_at": 3}}, {"library": remote, "notes": remote, "updated_at": 9, "settings": {"updated_at": 3, "theme": "dark"}}


@query(f"""with {SIDES}, either as (select *, true as mine from l union all select *, false from r), m as (select * from either qualify row_number() over (partition by paper_id order by updated_at desc, mine desc) = 1)
select 'library' as name, paper_id, seq, deleted from m union all select 'progress', paper_id, seq, deleted from l union all select 'notes', paper_id, seq, deleted from r""")
def document_merge(spark, sf_dir):
    """Two whole documents of state merged, each lacking a table; those that both lack are empty."""
    local, remote = documents_of_state(spark, sf_dir)
    kinds = dict.fromkeys(st.TABLES, local["library"].withColumn("id", F.col("paper_id")).schema)
    merged = st.merge_documents(st.normalise(spark, local, kinds), st.normalise(spark, remote, kinds))
    tables = [merged[name].select(F.lit(name).alias("name"), "paper_id", "seq", "deleted") for name in st.TABLES]
    return functools.reduce(DataFrame.unionByName, tables)


@query(f"with {SIDES} select (select 2 * count(*) from l) as local_records, (select 2 * count(*) from r) as remote_records")
def record_counts(spark, sf_dir):
    """How many records each side's document has, tombstones included."""
    local, remote = documents_of_state(spark, sf_dir)
    return spark.createDataFrame([(st.record_count(local), st.record_count(remote))], "local_records long, remote_records long")


@query(f"with {SIDES} select 'library' as name, paper_id, seq, deleted, updated_at from l union all select 'progress', paper_id, seq, deleted, updated_at from l")
def export_round_trip(spark, sf_dir):
    """A side's document written as JSON and read back, tombstones included."""
    local, _ = documents_of_state(spark, sf_dir)
    path = scratch(spark, "export")
    exports.write_state(local, path)
    back = exports.read_state(spark, path, {name: local["library"].schema for name in ("library", "progress", "notes")})
    tables = [back[n].select(F.lit(n).alias("name"), "paper_id", "seq", "deleted", "updated_at") for n in ("library", "progress")]
    return tables[0].unionByName(tables[1])


@query(f"with {duck.WON}, {duck.PAPERS} select paper_id, title, substr(published, 1, 4) as year from won join papers on paper_id = 'u' || source_id where not deleted")
def library_citations(spark, sf_dir):
    """Title and year of every live entry's citation."""
    papers = pp.papers(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    found = exports.citations(entries(spark, sf_dir), papers.drop("doc_id"))
    return found.select("paper_id", F.regexp_extract("entry", r"(?s)title  = \{(.*)\},\n  author", 1).alias("title"), F.regexp_extract("entry", r"year   = \{(\d{4})", 1).alias("year"))


@query(f"with u as ({SECTION_UNITS}) select doc_id, cast(sum(minutes) filter (where not appendix) as int) as minutes, cast(sum(minutes) as int) as with_appendix, cast(count(*) filter (where not appendix and key = 'intro') as int) as done, cast(count(*) filter (where not appendix) as int) as total, cast(coalesce(sum(minutes) filter (where not appendix and key <> 'intro'), 0) as int) as remaining from u group by 1")
def unit_totals(spark, sf_dir):
    """What every document's units take to read, and what is left once the first is done."""
    rows = sr.structure(text_pages(spark, sf_dir)).select("doc_id", F.col("doc.units").alias("u"))
    progress = sr.progress_of(F.col("u"), F.array(F.lit("intro")))
    return rows.select("doc_id", sr.total_minutes(F.col("u")).alias("minutes"), sr.total_minutes(F.col("u"), True).alias("with_appendix"), progress.alias("p")).select("doc_id", "minutes", "with_appendix", "p.done", "p.total", "p.remaining")


WHITE = r"'[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'"


def clean(text: str) -> str:
    return f"trim(regexp_replace({text}, {WHITE}, ' ', 'g'))"


@query(f"""{"with " + duck.PAPERS}, c as (select source_id, id, {clean("title")} as title, {clean("abstract")} as abstract, authors, categories, published, source_id % 10 = 0 as deleted from papers)
select id, case when deleted then '' else title end as title, case when deleted then '' else abstract end as abstract, case when deleted then '' else authors[1] || '|' || authors[2] end as authors, case when deleted then '' else array_to_string(categories, ' ') end as categories, case when deleted then '' else published end as published, deleted from c where deleted or title <> ''""")
def feed_records(spark, sf_dir):
    """Every paper as a feed's XML record, every tenth a tombstone, parsed."""
    plain = lambda c: F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    rows, c = pp.papers(spark, sf_dir), F.col
    author = lambda k: F.concat(F.lit("<author><keyname>"), plain(F.get("authors", F.lit(k))), F.lit("</keyname></author>"))
    body = F.concat(tag("id", c("id")), tag("created", c("published")), tag("title", plain(c("title"))), tag("categories", F.array_join("categories", "  ")), tag("abstract", plain(c("abstract"))), tag("authors", F.concat(author(0), author(1))))
    head = F.concat(F.lit("<identifier>oai:x:"), c("id"), F.lit("</identifier><datestamp>2024-01-01</datestamp>"))
    record = F.when(c("doc_id") % 10 == 0, F.concat(F.lit("<record><header status='deleted'>"), head, F.lit("</header></record>"))).otherwise(F.concat(F.lit("<record><header>"), head, F.lit("</header><metadata><arXiv>"), body, F.lit("</arXiv></metadata></record>")))
    found = feeds.records(rows.select(F.from_xml(record, feeds.FEED).alias("r")).select("r.*"))
    return found.select("id", "title", "abstract", F.array_join("authors", "|").alias("authors"), F.array_join("categories", " ").alias("categories"), "published", "deleted")


@query("with " + duck.PAPERS + " select id, title, published, array_to_string(categories, ' ') as categories from papers where source_id % 7 <> 3")
def log_records(spark, sf_dir):
    """A harvest log written as lines, some blank and some torn, and read."""
    rows, path = pp.papers(spark, sf_dir), scratch(spark, "log")
    line = F.to_json(F.struct("id", "title", "categories", "published", "abstract"))
    torn = F.when(F.col("doc_id") % 7 == 3, F.substring(line, 1, 30)).otherwise(line)
    rows.select(F.explode(F.array(torn, F.when(F.col("doc_id") % 5 == 0, "").otherwise(" "))).alias("value")).write.text(path)
    return feeds.read_records(spark, path).select("id", "title", "published", F.array_join("categories", " ").alias("categories"))


@query(f"""with {duck.DOCS}, w as (select strftime(date_trunc('month', cast(max(published) as date)) - interval 24 month, '%Y-%m-%d') as cutoff from docs)
select doc_id, cast(case when published >= cutoff then len({duck.terms('abstract', True)}) else 0 end as bigint) as indexed, case when abstract <> '' then len({duck.terms('abstract', True)}) end as length from docs, w""")
def abstract_window(spark, sf_dir):
    """How many of each abstract's terms an index of two years' abstracts has, and its length, which counts whatever its age."""
    docs = built(spark, sf_dir).docs
    newest = docs.agg(F.max("published").alias("newest"))
    cutoff = newest.select(tx.months_before(F.col("newest"), 24)).first()[0] or ""
    counted = ix.count_terms(docs, cutoff)
    indexed = F.aggregate("terms", F.lit(0), lambda n, t: n + t["abstract"])
    return counted.select("doc_id", indexed.cast("long").alias("indexed"), F.col("abstract_length").cast("long").alias("length"))


@query("with " + duck.PAPERS + ", d as (select 'u' || source_id as id, title from papers) select case when turn % 2 = 0 then 'note' else 'highlight' end as source, 'u' || conv_id as paper_id, case when turn % 2 = 0 then text else '\"' || text || '\"' end as body, d.title from conversations left join d on d.id = 'u' || conv_id where contains(lower(text), 'tion')")
def notes_titles(spark, sf_dir):
    """Notes and highlights that hold a word, with the titles of the papers they belong to."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("paper_id"), "turn", "text", F.lit(False).alias("deleted"))
    notes = rows.filter("turn % 2 = 0").select("paper_id", F.col("text").alias("body"), "deleted")
    marks = rows.filter("turn % 2 <> 0").select("paper_id", F.col("text").alias("exact"), F.lit(None).cast("string").alias("note"), "deleted")
    return st.search_notes(notes, marks, "tion", known_papers(spark, sf_dir))


@query(f"with {duck.DOCS} select p.id, case when d.id is not null then d.abstract when p.source_id % 2 = 0 then '' end as abstract, case when d.id is not null or p.source_id % 2 = 0 then p.title else p.id end as title from papers p left join docs d using (id)")
def resolved_papers(spark, sf_dir):
    """Every paper from the index, else from a cache of titles that has half of them, else bare."""
    rows = pp.papers(spark, sf_dir)
    indexed = built(spark, sf_dir).docs.select("id", "abstract", "title")
    cached = rows.filter(F.col("doc_id") % 2 == 0).select("id", F.lit("").alias("abstract"), "title")
    bare = rows.select("id", F.lit(None).cast("string").alias("abstract"), F.col("id").alias("title"))
    return st.fill_gaps(indexed, cached, bare).select("id", "abstract", "title")


@query(f"with {duck.DOCS} select count(*) as doc_count, false as moved, true as stale, false as fresh from docs")
def index_age(spark, sf_dir):
    """Whether the built index is another than itself, and stale after half a day."""
    manifest = built(spark, sf_dir).manifest
    age = lambda ms: exports.is_stale(F.col("built_at"), F.col("built_at") + ms)
    return manifest.select("doc_count", F.lit(exports.has_moved(manifest, manifest)).alias("moved"), age(13 * 3600 * 1000).alias("stale"), (~age(11 * 3600 * 1000)).alias("fresh")).withColumn("fresh", ~F.col("fresh"))
