"""Registered queries of the literature engine, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batch as bt
from ..operators import index as ix
from ..operators import papers as pp
from ..operators import search as se
from ..operators import state as st
from ..operators import structure as sr
from ..sources import commits, snapshots
from ..storage import shared_dir, stamp
from ..streaming import streams
from . import duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_built: dict[tuple[str, str], tuple[str, ix.Index]] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def built(spark: SparkSession, sf_dir: str) -> ix.Index:
    """The index of a folder, built once an application and again when its documents have changed; a failed build leaves none."""
    key, state = (spark.sparkContext.applicationId, sf_dir), stamp(spark, f"{sf_dir}/documents.parquet")
    if _built.get(key, ("", None))[0] != state:
        _built.pop(key, None)
        _built[key] = state, ix.build(pp.papers(spark, sf_dir))
    return _built[key][1]


def values(*rows: tuple, names: str) -> str:
    """SQL of literal rows, for results that were worked out by hand."""
    show = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as v({names})"


# Text

P = f"with {duck.PAPERS} "
#: Four words of every document, other than ``and``.
W = "with w as (select doc_id, coalesce(w[1], 'none') as w1, coalesce(w[2], 'none') as w2, coalesce(w[3], 'none') as w3, coalesce(w[4], 'none') as w4 from (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{2,}'), lambda x: lower(x) <> 'and') as w from documents))"
X = "w1 || '-' || w2 || ' C++ f# ' || w3 || '—' || w4 || ' 1999 1800 123 a --' || w1 || '--' || repeat(w2, 9)"


def four_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0)), lambda w: F.lower(w) != "and")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", found.alias("w"))
    return rows.select("doc_id", *[F.coalesce(F.get("w", F.lit(k)), F.lit("none")).alias(f"w{k + 1}") for k in range(4)])


@query(f"{P} select id, len({duck.terms('title')}) as title_terms, len({duck.terms('abstract', True)}) as abstract_terms, len(list_distinct({duck.terms('abstract', True)})) as distinct_terms from papers")
def token_counts(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.term_counts(F.col("title"), F.col("abstract")).alias("n")).select("id", "n.*")


@query(f"{P} select id, lower(strip_accents(title)) as folded from papers")
def folded_titles(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.fold(F.col("title")).alias("folded"))


@query(f"{W} select doc_id, array_to_string({duck.terms(X)}, ' ') as terms from w")
def term_cases(spark, sf_dir):
    """Terms of hyphenated and dashed words, marks, years and bare numbers around every document's words."""
    a, b, c, d = (F.col(f"w{k}") for k in range(1, 5))
    x = F.concat(a, F.lit("-"), b, F.lit(" C++ f# "), c, F.lit("—"), d, F.lit(" 1999 1800 123 a --"), a, F.lit("--"), F.repeat(b, 9))
    return four_words(spark, sf_dir).select("doc_id", F.array_join(tx.terms(x), " ").alias("terms"))


@query(f"{P} select regexp_replace(substr(term, 1, 2), '[^a-z0-9]', '_', 'g') as shard, count(*) as n from (select distinct unnest({duck.terms('title')}) as term from papers) group by 1")
def term_shards(spark, sf_dir):
    words = pp.papers(spark, sf_dir).select(F.explode(tx.terms(F.col("title"))).alias("term")).distinct()
    return words.groupBy(tx.shard_key(F.col("term")).alias("shard")).agg(F.count("term").alias("n"))


@query(f"{P} select substr(id, 1, 4) as id_shard, count(*) as n from papers group by 1")
def id_shards(spark, sf_dir):
    return pp.papers(spark, sf_dir).groupBy(tx.id_shard_key(F.col("id")).alias("id_shard")).agg(F.count("id").alias("n"))


@query(f"{P} select source_id, case source_id % 6 when 4 then 'math.GT/' || lpad(cast(source_id as varchar), 7, '0') when 3 then null when 5 then null else id end as id from papers")
def identifiers(spark, sf_dir):
    """Every paper's identifier out of an address, a bare, a prefixed and a legacy form; texts without one."""
    rows, own, number = pp.papers(spark, sf_dir), F.col("id"), F.col("doc_id")
    forms = [F.concat(F.lit(" "), own, F.lit("v2 ")), F.concat(F.lit("https://arxiv.org/abs/"), own, F.lit("v7")), F.concat(F.lit("arXiv: "), own), F.col("title"), F.concat(F.lit("http://arxiv.org/pdf/math.GT/"), F.lpad(number.cast("string"), 7, "0")), F.concat(F.lit("see "), own)]
    x = F.coalesce(*[F.when(number % 6 == k, f) for k, f in enumerate(forms)])
    return rows.select(number.alias("source_id"), tx.extract_id(x).alias("id"))


@query(f"{P} select id, case when len(authors) <= 1 then authors[1] else authors[1] || ' and ' || cast(len(authors) - 1 as varchar) || ' more' end as label, list_transform(categories, lambda c: case c when 'cs.AI' then 'Artificial Intelligence' when 'cs.LG' then 'Machine Learning' when 'cs.CL' then 'Computation and Language' when 'cs.CV' then 'Computer Vision' when 'cs.NE' then 'Neural and Evolutionary Computing' when 'stat.ML' then 'Machine Learning (Statistics)' when 'cs.RO' then 'Robotics' else 'Information Retrieval' end)[1] as category from papers")
def author_labels(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.author_label(F.col("authors"), 1).alias("label"), tx.category_name(F.get("categories", F.lit(0))).alias("category"))


@query(f"""{P} select id, concat('@misc{{', lower(list_extract(string_split(authors[1], ' '), -1)), substr(published, 1, 4), coalesce(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3)[1], 'paper'), ',', chr(10),
 '  title  = {{', title, '}},', chr(10), '  author = {{', array_to_string(authors, ' and '), '}},', chr(10), '  year   = {{', substr(published, 1, 4), '}},', chr(10), '  eprint = {{', id, '}},', chr(10), '  archivePrefix = {{arXiv}},', chr(10),
 '  primaryClass = {{', categories[1], '}},', chr(10), '  url    = {{https://arxiv.org/abs/', id, '}}', chr(10), '}}') as entry from papers""")
def bibtex(spark, sf_dir):
    c = F.col
    return pp.papers(spark, sf_dir).select("id", tx.bibtex(c("id"), c("title"), c("authors"), c("published"), c("categories")).alias("entry"))


@query(f"""{P}, m as (select id, abstract, case when instr(lower(abstract), 'tion') = 0 then instr(lower(abstract), 'ein') when instr(lower(abstract), 'ein') = 0 then instr(lower(abstract), 'tion') else least(instr(lower(abstract), 'tion'), instr(lower(abstract), 'ein')) end as p from papers)
 select id, case when abstract = '' then '' when p = 0 then substr(abstract, 1, 260) else concat(case when p > 61 then '…' else '' end, substr(abstract, greatest(0, p - 61) + 1, 260), case when greatest(0, p - 61) + 260 < length(abstract) then '…' else '' end) end as snippet from m""")
def snippets(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.snippet(F.col("abstract"), F.array(F.lit("tion"), F.lit("ein"))).alias("snippet"))


@query(f"{P} select id, regexp_replace(title, '(tion|the)', '<mark>\\1</mark>', 'gi') as marked from papers")
def emphasis(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.emphasise(F.col("title"), ["tion", "the", "x"]).alias("marked"))


@query(f"""{W} select doc_id, case doc_id % 5 when 0 then w1 || ' ' || w2 when 1 then w1 || ' + y is ' || w2 when 2 then 'He said "' || w1 || '" – and — ' || w2 when 3 then w1 || ' ' || w2 else w1 || ' ' || w2 || chr(92) end as clean from w""")
def latex(spark, sf_dir):
    """Every document's words in nested and bare commands, maths, quotes, dashes and groups."""
    a, b, c = (F.col(f"w{k}") for k in range(1, 4))
    forms = [(r"\emph{\textbf{", a, "}} ", b, ""), ("$", a, r" + y$ is \noindent ", b, ""), ("He said ``", a, "'' -- and --- ", b, ""), (r"{\it ", a, r"} \mycmd{", b, "}"), ("", a, "~", b, "\\\\")]
    texts = [F.concat(F.lit(p), x, F.lit(m), y, F.lit(q), *([c] if k == 4 else [])) for k, (p, x, m, y, q) in enumerate(forms)]
    return four_words(spark, sf_dir).select("doc_id", tx.clean_latex(F.coalesce(*[F.when(F.col("doc_id") % 5 == k, t) for k, t in enumerate(texts)])).alias("clean"))


@query(f"{P} select id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug, len(list_filter(regexp_split_to_array(abstract, '[\\s ]+'), lambda w: w <> '')) as words, greatest(1, cast(floor(len(list_filter(regexp_split_to_array(abstract, '[\\s ]+'), lambda w: w <> '')) / 180 + 0.5) as int)) as minutes from papers")
def reading_sizes(spark, sf_dir):
    words = tx.word_count(F.col("abstract"))
    return pp.papers(spark, sf_dir).select("id", tx.slug(F.col("title")).alias("slug"), words.cast("long").alias("words"), tx.minutes_for(words).alias("minutes"))


@query("""with e as (select event_id, value / 490 as p, greatest(0, (case when event_id % 40 > 0 then event_id % 40 else 12 end) * 600 / 180 * (1 - value / 490)) as l from events)
select event_id, cast(least(100, greatest(0, floor(p * 100 + 0.5))) as bigint) || '%' as percent, case when l < 1 then 'less than a minute left' when l < 60 then cast(floor(l + 0.5) as bigint) || ' min left' else regexp_replace(cast(floor(l / 60 * 10 + 0.5) / 10 as varchar), '[.]0$', '') || ' h left' end as left_over from e""")
def progress_labels(spark, sf_dir):
    """Each event's progress as it is shown, of papers with up to 39 pages or an unknown number."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("value") / 490).alias("p"), F.nullif(F.col("event_id") % 40, F.lit(0)).alias("pages"))
    return rows.select("event_id", tx.percent_label(F.col("p")).alias("percent"), tx.reading_time(F.col("p"), F.col("pages")).alias("left_over"))


@query("""with b as (select max(epoch_us(ts) // 1000) as last, min(epoch_us(ts) // 1000) as first from events),
s as (select event_id, floor((epoch_us(ts) // 1000 - case when event_id % 2 = 0 then last else first end) / 1000 + 0.5) as s from events, b),
u as (select event_id, s, case when abs(s) >= 31536000 then 'year' when abs(s) >= 2592000 then 'month' when abs(s) >= 604800 then 'week' when abs(s) >= 86400 then 'day' when abs(s) >= 3600 then 'hour' when abs(s) >= 60 then 'minute' else 'second' end as u from s),
n as (select *, cast(floor(s / case u when 'year' then 31536000 when 'month' then 2592000 when 'week' then 604800 when 'day' then 86400 when 'hour' then 3600 when 'minute' then 60 else 1 end + 0.5) as bigint) as n from u)
select event_id, case when s = 0 then 'now' when abs(n) = 1 and u = 'day' then case when n < 0 then 'yesterday' else 'tomorrow' end when abs(n) = 1 and u in ('week', 'month', 'year') then case when n < 0 then 'last ' else 'next ' end || u
 when n < 0 then -n || ' ' || u || case when n = -1 then '' else 's' end || ' ago' else 'in ' || n || ' ' || u || case when n = 1 then '' else 's' end end as label from n""")
def relative_dates(spark, sf_dir):
    """Every event's time as seen from the last one, or from the first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    ends = events.agg(F.max("at").alias("last"), F.min("at").alias("first"))
    return events.join(F.broadcast(ends), F.lit(True)).select("event_id", tx.relative_label(F.col("at"), F.when(F.col("event_id") % 2 == 0, F.col("last")).otherwise(F.col("first"))).alias("label"))


@query("select doc_id as n, cast(date '2020-01-01' + cast(doc_id % 900 as int) as varchar) as iso, strftime(date_trunc('month', date_trunc('month', date '2020-01-01' + cast(doc_id % 900 as int)) - interval 3 month + to_days(cast(day(date '2020-01-01' + cast(doc_id % 900 as int)) - 1 as int))), '%Y-%m-%d') as cutoff from documents")
def month_cutoffs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("n"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")).cast("string").alias("iso"))
    return rows.select("n", "iso", tx.months_before(F.col("iso"), 3).alias("cutoff"))


@query("select doc_id, coalesce(text, '') as decoded from documents")
def entities(spark, sf_dir):
    """Every document's text out of its escaped form, named entities and numeric ones of both kinds."""
    x = F.coalesce("text", F.lit(""))
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("e", "&#101;"), ("é", "&#xE9;")):
        x = F.replace(x, F.lit(ch), F.lit(name))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.decode_entities(x).alias("decoded"))


@query(f"{W} select doc_id, array_to_string(list_filter(case when w1 || ' ' || w2 = w3 || ' ' || w4 then [w1 || ' ' || w2] else [w1 || ' ' || w2, w3 || ' ' || w4] end, lambda x: length(x) between 2 and 79), '|') as names from w")
def author_blocks(spark, sf_dir):
    """Names made of every document's words, with marks, an affiliation and an address around them."""
    a, b, c, d = (F.col(f"w{k}") for k in range(1, 5))
    block = F.concat(F.lit("\n"), a, F.lit(" "), b, F.lit("1\nSome Lab\n"), c, F.lit("@lab.org &"), c, F.lit(" "), d, F.lit(" footnotemark: 2"))
    return four_words(spark, sf_dir).select("doc_id", F.array_join(tx.author_names(block), "|").alias("names"))


@query(f"{P} select id, contains(lower(strip_accents(title)), 'of the') as found from papers")
def title_phrases(spark, sf_dir):
    return pp.papers(spark, sf_dir).select("id", tx.contains_phrase(F.col("title"), "Of The").alias("found"))


@query(f"{P} select id, category, string_split(category, '.')[1] || ':' || replace(category, '.', ':') as set_name, strftime(cast(published as date), '%b %-d, %Y') as label from (select id, published, unnest(categories) as category from papers)")
def feed_sets(spark, sf_dir):
    """The feed's set of every category of every paper, and its date as it is shown."""
    rows = pp.papers(spark, sf_dir).select("id", "published", F.explode("categories").alias("category"))
    return rows.select("id", "category", tx.set_name(F.col("category")).alias("set_name"), tx.date_label(F.col("published")).alias("label"))


# Corpus and index


@query(f"{P} select source_id, id, title, abstract, authors[1] as author, categories[1] as category, len(categories) as n_categories, published, updated from papers")
def papers(spark, sf_dir):
    return pp.papers(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "id", "title", "abstract", F.get("authors", F.lit(0)).alias("author"), F.get("categories", F.lit(0)).alias("category"), F.size("categories").cast("long").alias("n_categories"), "published", "updated")


@query(f"with {duck.DOCS} select doc_id, source_id, id, published, updated, doc_id // 512 as chunk from docs")
def doc_numbering(spark, sf_dir):
    return built(spark, sf_dir).docs.select("doc_id", "source_id", "id", "published", "updated", F.col("chunk").cast("long").alias("chunk"))


@query(f"with {duck.DOCS}, {duck.STATS} select n as doc_count, abstract_docs, round(a1, 4) as avg_title, round(a2, 4) as avg_author, round(a4, 4) as avg_category, round(a8, 4) as avg_abstract, newest, oldest from stats")
def corpus_stats(spark, sf_dir):
    stats = ix.corpus_stats(built(spark, sf_dir).counted)
    return stats.select("doc_count", "abstract_docs", *[F.round(c, 4).alias(c) for c in ("avg_title", "avg_author", "avg_category", "avg_abstract")], "newest", "oldest")


@query(f"with {duck.POSTINGS} select term, doc_id, mask, weight from post")
def postings(spark, sf_dir):
    return built(spark, sf_dir).postings.select("term", "doc_id", "mask", "weight")


@query(f"with {duck.POSTINGS} select term, doc_id - lag(doc_id, 1, 0) over (partition by term order by doc_id) as delta, mask, weight from post")
def postings_delta(spark, sf_dir):
    return ix.delta_coded(built(spark, sf_dir).postings).select("term", "delta", "mask", "weight")


@query(f"with {duck.POSTINGS} select term, doc_id, mask, weight from post")
def postings_decoded(spark, sf_dir):
    return ix.delta_decoded(ix.delta_coded(built(spark, sf_dir).postings))


@query(f"with {duck.POSTINGS} select term, df, round({duck.IDF}, 6) as idf from df, stats")
def doc_frequency(spark, sf_dir):
    index = built(spark, sf_dir)
    return index.frequencies.select("term", "df", F.round(ix.idf(F.col("df"), F.lit(index.doc_count)), 6).alias("idf"))


@query(f"with {duck.POSTINGS} select n as doc_count, (n + 511) // 512 as chunk_count, (select count(*) from df) as term_count, (select count(*) from post) as posting_count, newest, oldest, round(a1, 2) as avg_title, round(a8, 2) as avg_abstract from stats")
def index_stats(spark, sf_dir):
    return built(spark, sf_dir).manifest.select("doc_count", "chunk_count", "term_count", "posting_count", "newest", "oldest", "avg_title", "avg_abstract")


@query(f"with {duck.POSTINGS} select regexp_replace(substr(term, 1, 2), '[^a-z0-9]', '_', 'g') as shard, count(distinct term) as n_terms, count(*) as n_postings from post group by 1")
def posting_shards(spark, sf_dir):
    return built(spark, sf_dir).postings.groupBy("shard").agg(F.count_distinct("term").alias("n_terms"), F.count("term").alias("n_postings"))


@query(f"with {duck.DOCS} select doc_id, id, title, published from docs where doc_id < 200")
def recent_feed(spark, sf_dir):
    return snapshots.recent(built(spark, sf_dir)).select("doc_id", "id", "title", "published")


@query(f"with {duck.DOCS} select replace(substr(published, 1, 7), '-', '') as month, count(*) as n, count(*) filter (where abstract <> '') as with_abstract from docs group by 1")
def docs_by_month(spark, sf_dir):
    docs = built(spark, sf_dir).docs
    return docs.groupBy(F.replace(F.substring("published", 1, 7), F.lit("-"), F.lit("")).alias("month")).agg(F.count("id").alias("n"), F.count(F.when(F.col("abstract") != "", 1)).alias("with_abstract"))


@query(f"with {duck.DOCS}, asked as (select id || 'v2' as id, id as bare from papers) select a.id, d.doc_id from asked a left join docs d on a.bare = d.id")
def id_lookup(spark, sf_dir):
    """Identifiers with versions to document numbers; those out of scope have none."""
    return snapshots.look_up(built(spark, sf_dir).ids, pp.papers(spark, sf_dir).select(F.concat("id", F.lit("v2")).alias("id")))


@query(f"with {duck.LOG}, last as (select * from log qualify row_number() over (partition by paper_id order by seq desc) = 1) select paper_id, seq, event_type from last where not deleted")
def compaction(spark, sf_dir):
    return pp.compact(st.state_log(spark, sf_dir), ["seq"], key="paper_id").select("paper_id", "seq", "event_type")


@query(f"with {duck.DOCS} select doc_id, doc_id // 512 as chunk, id, title, authors, categories, published, updated, abstract, cast(null as varchar) as comment, cast(null as varchar) as doi, cast(null as varchar) as journal_ref from docs")
def snapshot_round_trip(spark, sf_dir):
    """Every document of every display chunk with all its metadata, read back from a written snapshot."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.write_snapshot(built(spark, sf_dir), path)
    snapshots.read_manifest(spark, path)
    found = snapshots.details(spark, path, snapshots.read_docs(spark, path))
    return found.select("doc_id", F.col("chunk").cast("long").alias("chunk"), "id", "title", "authors", "categories", "published", "updated", "abstract", "comment", "doi", "journal_ref")


# Search


def searched(spark, sf_dir, text, **options):
    return se.search(built(spark, sf_dir), text, **options)


@query(duck.search([(0, "tion", 0), (1, "er", 0)]))
def search_and(spark, sf_dir):
    return searched(spark, sf_dir, "tion er")


@query(duck.search([(0, "the", 1), (1, "src7", 2)]))
def search_fielded(spark, sf_dir):
    return searched(spark, sf_dir, "ti:the au:src7")


@query(duck.search([(0, "tion", 0)], ("er", "es")))
def search_not(spark, sf_dir):
    return searched(spark, sf_dir, "tion -er -es")


@query(duck.search([(0, "of", 1), (1, "the", 1)], where="contains(lower(strip_accents(title)), 'of the')"))
def search_phrase(spark, sf_dir):
    return searched(spark, sf_dir, 'title:"of the"')


@query(duck.search([(0, "of", 0), (1, "the", 0)]))
def search_loose_phrase(spark, sf_dir):
    return searched(spark, sf_dir, '"of the"')


@query(duck.search([(0, "tion", 0)], sort="published desc,"))
def search_newest(spark, sf_dir):
    return searched(spark, sf_dir, "tion", filters=se.Filters(sort="newest"))


@query(duck.search([(0, "tion", 0)], sort="published asc,"))
def search_oldest(spark, sf_dir):
    return searched(spark, sf_dir, "tion", filters=se.Filters(sort="oldest"))


@query(duck.search([(0, "tion", 0)], offset=25))
def search_page2(spark, sf_dir):
    return searched(spark, sf_dir, "tion", offset=25)


@query(duck.search([(0, "tion", 0)], expand={1: "ther"}))
def search_prefix(spark, sf_dir):
    return searched(spark, sf_dir, "tion ther", incremental=True)


@query(duck.search([(0, "tion", 0)], where="list_has_any(list_transform(categories, lambda c: lower(c)), ['cs.lg', 'cs.cl']) and published >= '2018-01-01' and published <= '2023-12-31'"))
def search_filters(spark, sf_dir):
    return searched(spark, sf_dir, "tion cat:cs.CL", filters=se.Filters(categories=["cs.LG"], since="2018-01-01", until="2023-12-31"))


@query(duck.search([(0, "tion", 0), (1, "tion", 0)]))
def search_repeated(spark, sf_dir):
    return searched(spark, sf_dir, "tion tion")


@query(duck.search([(0, "tioner", 0), (1, "tion", 0), (2, "er", 0)]))
def search_hyphen(spark, sf_dir):
    return searched(spark, sf_dir, "tion-er")


@query(f"""{P} select h.rank, h.id, regexp_replace(h.title, '(tion|er)', '<mark>\\1</mark>', 'gi') as marked,
 regexp_replace(case when abstract = '' then '' when p = 0 then substr(abstract, 1, 260) else concat(case when p > 61 then '…' else '' end, substr(abstract, greatest(0, p - 61) + 1, 260), case when greatest(0, p - 61) + 260 < length(abstract) then '…' else '' end) end, '(tion|er)', '<mark>\\1</mark>', 'gi') as snippet
 from ({duck.search([(0, 'tion', 0), (1, 'er', 0)])}) h join (select id, abstract, coalesce(least(nullif(instr(lower(abstract), 'tion'), 0), nullif(instr(lower(abstract), 'er'), 0)), 0) as p from papers) a on h.id = a.id""")
def search_snippets(spark, sf_dir):
    """A page of hits as it is shown."""
    index = built(spark, sf_dir)
    return se.shown(index, se.search(index, "tion er"), "tion er").select("rank", "id", "marked", "snippet")


@query(f"with {duck.hits([(0, 'tion', 0)])} select (select count(*) from hits) as total, (select count(*) from scored) <= 4000 as total_known, (select count(*) from hits) > 25 as has_more")
def search_totals(spark, sf_dir):
    return se.totals(built(spark, sf_dir), "tion")


BROWSED = "select row_number() over (order by doc_id {0}) as rank, doc_id, id, title, published, 0e0 as score, 0 as matched_fields from docs where list_contains(categories, 'cs.LG') order by doc_id {0} limit 25"


@query(f"with {duck.DOCS} {BROWSED.format('')}")
def browse_newest(spark, sf_dir):
    return searched(spark, sf_dir, "cat:cs.lg")


@query(f"with {duck.DOCS} {BROWSED.format('desc')}")
def browse_oldest(spark, sf_dir):
    return searched(spark, sf_dir, "cat:cs.LG -tion", filters=se.Filters(sort="oldest"))


@query(f"with {duck.DOCS}, c as (select doc_id // 512 as chunk, count(*) as n from docs where list_contains(categories, 'cs.LG') group by 1), s as (select sum(n) over (order by chunk) as s from c) select cast(coalesce(min(s) filter (where s >= 26), max(s), 0) as bigint) as total, coalesce(max(s), 0) < 26 as total_known, coalesce(min(s) filter (where s >= 26), max(s), 0) > 25 as has_more from s")
def browse_totals(spark, sf_dir):
    return se.totals(built(spark, sf_dir), "cat:cs.LG")


SEED = f"""{duck.POSTINGS}, seed as (select doc_id as seed, title || ' ' || abstract as text from docs where doc_id = 5),
st as (select term, count(*) as tf, min(i) as place from (select unnest({duck.terms('text')}) as term, generate_subscripts({duck.terms('text')}, 1) as i from seed) where length(term) >= 4 group by 1),
rt as (select term, round((1 + ln(tf)) * {duck.IDF}, 9) as weight, place from st join df using (term), stats where df >= greatest(5, cast(floor(n * 0.0001 + 0.5) as int)) and df <= n * 0.03 order by 2 desc, place limit 20),
ranked as (select row_number() over (order by weight desc, place) as rank, term, weight from rt)"""


def seed_text(index):
    row = index.docs.filter("doc_id = 5").first()
    return f"{row['title']} {row['abstract']}" if row else ""


@query(f"with {SEED} select rank, term, round(weight, 6) as weight from ranked")
def related_terms(spark, sf_dir):
    index = built(spark, sf_dir)
    return se.related_terms(index, seed_text(index)).select(F.col("rank").cast("long").alias("rank"), "term", F.round("weight", 6).alias("weight"))


@query(f"""with {SEED}, sc as (select p.doc_id, round(sum(r.weight * (p.weight / 255e0 * 24)), 9) as score, min(rank) as first from post p join ranked r using (term) where p.doc_id <> 5 group by 1 order by first, doc_id limit 4000)
 select row_number() over (order by score desc, first, doc_id) as rank, doc_id, id, title, round(score, 6) as score from sc join docs using (doc_id) order by 1 limit 6""")
def related_papers(spark, sf_dir):
    index = built(spark, sf_dir)
    return se.related(index, seed_text(index), 5)


LIMIT = 10


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of queries made of ``benchmark``: each whole text, and each two neighbouring words in one of six forms."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    pairs = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("k")).filter(F.col("k") < F.size("w"))
    a, b = F.expr("element_at(w, k)"), F.expr("element_at(w, k + 1)")
    form = (F.col("item_id") + F.col("k")) % 6
    texts = [("", a, " ", b, ""), ("", a, " -", b, ""), ("ti:", a, " ", b, ""), ('"', a, " ", b, '"'), ('title:"', a, " ", b, '"'), ("cat:cs.LG ", a, "", F.lit(""), "")]
    text = F.coalesce(*[F.when(form == k, F.concat(F.lit(p), x, F.lit(m), y, F.lit(q))) for k, (p, x, m, y, q) in enumerate(texts)])
    return pairs.select((F.col("item_id") * 100_000 + F.col("k")).alias("query_id"), text.alias("text")).unionByName(items.select((F.col("item_id") * 100_000).alias("query_id"), "text"))


@query(f"with {duck.LOG_HITS} select query_id, rank, doc_id, id, title, published, score, matched_fields from page")
def search_log(spark, sf_dir):
    """Every query of a log in one pass over the index."""
    return bt.search_log(built(spark, sf_dir), query_log(spark, sf_dir), limit=LIMIT)


@query(f"with {duck.LOG_HITS} select query_id, coalesce(total, 0) as total, coalesce(n_scored, 0) <= 4000 as total_known, coalesce(total, 0) > 10 as has_more from k left join (select query_id, count(*) as total from hits group by 1) using (query_id) left join (select query_id, count(*) as n_scored from scored group by 1) using (query_id)")
def search_log_totals(spark, sf_dir):
    return bt.log_totals(built(spark, sf_dir), query_log(spark, sf_dir), limit=LIMIT)


@query(f"with {duck.LOG_HITS}, m as (select strftime(date_trunc('month', cast(max(published) as date)) - interval 24 month, '%Y-%m') as month from docs), ids as (select query_id from ql union all select item_id * 100000 from b) select query_id, case when query_id in (select query_id from slots where fields = 0) then month end as month from ids, m")
def log_notices(spark, sf_dir):
    """From which month abstracts are searched, for each query of the log that searches them, in an index of two years' abstracts."""
    dates = built(spark, sf_dir).dates
    cutoff = spark.range(1).select(tx.months_before(F.lit(dates["newest"] or None), 24)).first()[0]
    return bt.notices(query_log(spark, sf_dir), cutoff or "", dates["oldest"])


SEEDS = f"""{duck.POSTINGS}, st as (select seed, term, count(*) as tf, min(i) as place from (select doc_id as seed, unnest({duck.terms("title || ' ' || abstract")}) as term, generate_subscripts({duck.terms("title || ' ' || abstract")}, 1) as i from docs) where length(term) >= 4 group by 1, 2),
rt as (select seed, term, round((1 + ln(tf)) * {duck.IDF}, 9) as weight, place from st join df using (term), stats where df >= greatest(5, cast(floor(n * 0.0001 + 0.5) as int)) and df <= n * 0.03),
ranked as (select * from (select *, row_number() over (partition by seed order by weight desc, place) as rank from rt) where rank <= 20)"""


@query(f"with {SEEDS} select seed, rank, term, round(weight, 6) as weight from ranked")
def related_terms_all(spark, sf_dir):
    marked = bt.marked_terms(built(spark, sf_dir))
    return marked.select("seed", F.col("rank").cast("long").alias("rank"), "term", bt.six_places(F.col("term_weight")).alias("weight"))


@query(f"""with {SEEDS}, sc as (select seed, p.doc_id, round(sum(r.weight * (p.weight / 255e0 * 24)), 9) as score, min(rank) as first from post p join ranked r using (term) where p.doc_id <> seed group by 1, 2
 qualify row_number() over (partition by seed order by first, p.doc_id) <= 4000), top as (select *, row_number() over (partition by seed order by score desc, first, doc_id) as rank from sc)
 select seed, rank, doc_id, id, title, round(score, 6) as score from top join docs using (doc_id) where rank <= 6""")
def related_papers_all(spark, sf_dir):
    """Six related papers for every paper."""
    return bt.related_all(built(spark, sf_dir))


# State


@query(f"with {duck.WON} select paper_id, seq, is_local, deleted, updated_at from won")
def lww_merge(spark, sf_dir):
    log = st.state_log(spark, sf_dir)
    merged = st.merge(log.filter("is_local"), st.latest(log.filter("not is_local")), "paper_id", "seq")
    return merged.select("paper_id", "seq", "is_local", "deleted", "updated_at")


@query(f"with {duck.WON} select paper_id, seq, deleted from won where not deleted or (select max(updated_at) from log) - updated_at < 86400000")
def tombstone_prune(spark, sf_dir):
    log = st.state_log(spark, sf_dir)
    now = log.agg(F.max("updated_at")).first()[0] or 0
    return st.prune(st.latest(log), now, 86_400_000).select("paper_id", "seq", "deleted")


@query(f"with {duck.WON}, top as (select *, least(value / 490, 1e0) as percent from won order by updated_at desc, seq desc limit 36) select paper_id, seq, round(percent, 6) as percent from top where not deleted and percent < 0.97 order by updated_at desc, seq desc limit 12")
def shelf(spark, sf_dir):
    rows = st.latest(st.state_log(spark, sf_dir)).withColumn("percent", F.least(F.col("value") / 490, F.lit(1.0)))
    return st.shelf(rows).select("paper_id", "seq", F.round("percent", 6).alias("percent"))


@query(f"with {duck.LOG} select tag, count(*) as count from (select distinct paper_id, lower(trim(event_type)) as tag from log where not deleted) group by 1")
def tag_counts(spark, sf_dir):
    log = st.live(st.state_log(spark, sf_dir))
    entries = log.groupBy("paper_id").agg(F.collect_set(F.concat(F.lit(" "), F.upper("event_type"))).alias("t"), F.lit(False).alias("deleted"))
    return st.tag_counts(entries.withColumn("tags", st.normal_tags(F.col("t"))))


@query(f"with {duck.WON} select 'u' || substr(paper_id, 2) || '#intro' as id, event_type as rating from won where not deleted and event_type in ('view', 'click') order by updated_at desc, 1 limit 50")
def revisits(spark, sf_dir):
    rows = st.latest(st.state_log(spark, sf_dir)).withColumn("id", F.concat("paper_id", F.lit("#intro")))
    rated = rows.withColumn("rating", F.when(F.col("event_type") == "view", "fuzzy").when(F.col("event_type") == "click", "lost"))
    return st.revisits(rated).select("id", F.col("event_type").alias("rating"))


@query("select trim(event_type || ' ' || (user_id % 40)) as query, max(epoch_us(ts) // 1000) as \"at\" from events group by 1 order by 2 desc, 1 limit 60")
def history(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.concat(F.lit("  "), "event_type", F.lit(" "), (F.col("user_id") % 40).cast("string")).alias("query"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return st.history(rows)


@query("select case when turn % 2 = 0 then 'note' else 'highlight' end as source, cast(conv_id as varchar) || '-' || turn as paper_id, case when turn % 2 = 0 then text else '\"' || text || '\"' end as body from conversations where contains(lower(text), 'tion')")
def notes_search(spark, sf_dir):
    """All turns are searched: the even ones as notes, the odd ones as highlights."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("paper_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).withColumn("deleted", F.lit(False))
    notes = rows.filter("turn % 2 = 0").select("paper_id", F.col("text").alias("body"), "deleted")
    marks = rows.filter("turn % 2 <> 0").select("paper_id", F.col("text").alias("exact"), F.lit(None).cast("string").alias("note"), "deleted")
    return st.search_notes(notes, marks, " TION ").drop("title")


@query("select event_id, case when least(value / 490, 1e0) > 0.95 then 'finished' when least(value / 490, 1e0) > 0.02 then 'reading' else 'unread' end as status from events")
def status_promotion(spark, sf_dir):
    percent = F.least(F.col("value") / 490, F.lit(1.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", st.promoted(F.lit("unread"), percent).alias("status"))


@query(f"with {duck.WON} select paper_id, event_type as status from won where not deleted and event_type = 'view'")
def library_filter(spark, sf_dir):
    rows = st.latest(st.state_log(spark, sf_dir)).withColumn("status", F.col("event_type")).withColumn("added_at", F.col("updated_at"))
    return st.library(rows, status="view").select("paper_id", "status")


@query(f"with {duck.WON} select paper_id, case when deleted then 'unread' else event_type end as status, case when deleted then 7 else updated_at end as added_at from won")
def library_upsert(spark, sf_dir):
    """Every paper starred: the deleted ones come back with default values."""
    rows = st.latest(st.state_log(spark, sf_dir))
    none = F.expr("cast(array() as array<string>)")
    entries = rows.select("paper_id", F.col("event_type").alias("status"), F.lit(False).alias("starred"), none.alias("collection_ids"), none.alias("tags"), F.col("updated_at").alias("added_at"), "updated_at", "deleted")
    changes = rows.select("paper_id", F.lit(None).cast("string").alias("status"), F.lit(True).alias("starred"), F.lit(None).cast("array<string>").alias("collection_ids"), F.lit(None).cast("array<string>").alias("tags"), F.lit(True).alias("changed"))
    return st.upsert(entries, changes, 7).filter("starred and not deleted").select("paper_id", "status", F.col("added_at").cast("long").alias("added_at"))


@query("""with recursive r as (select user_id as key, epoch_us(ts) // 60000000 as t, row_number() over (partition by user_id order by epoch_us(ts) // 60000000, event_id) as k from events),
s as (select key, k, t as first, t as last, cast(null as bigint) as saved from r where k = 1
 union all select r.key, r.k, case when least(s.last + 900, s.first + 1200) <= r.t then r.t else s.first end, r.t, case when least(s.last + 900, s.first + 1200) <= r.t then least(s.last + 900, s.first + 1200) end
 from s join r on r.key = s.key and r.k = s.k + 1)
select key, saved as saved_at from s where saved is not null union all select key, least(last + 900, first + 1200) from s where (key, k) in (select key, max(k) from r group by key)""")
def debounced_saves(spark, sf_dir):
    """Requests come at each event's minute, as if minutes were milliseconds, so that many fall within the quiet period."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return st.save_times(events.select(F.col("user_id").alias("key"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long").alias("at")))


SIDES = f"{duck.LOG}, l as (select * from log where is_local qualify row_number() over (partition by paper_id order by updated_at desc, seq desc) = 1), r as (select * from log where not is_local qualify row_number() over (partition by paper_id order by updated_at desc, seq desc) = 1)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The latest records of the local side, and of the remote one."""
    log = st.state_log(spark, sf_dir)
    return st.latest(log.filter("is_local")), st.latest(log.filter("not is_local"))


def known_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers under the identifiers that the state log has."""
    return pp.papers(spark, sf_dir).select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("id"), "title")


@query(f"with {duck.WON}, {duck.PAPERS} select w.paper_id, p.title, case when event_type = 'view' then round(least(value / 490, 1e0), 6) end as percent from won w left join papers p on w.paper_id = 'u' || p.source_id where not deleted")
def library_papers(spark, sf_dir):
    """Library entries with their papers' titles and what was read of them."""
    won = st.latest(st.state_log(spark, sf_dir)).withColumn("added_at", F.col("updated_at"))
    progress = won.filter("event_type = 'view'").withColumn("percent", F.round(F.least(F.col("value") / 490, F.lit(1.0)), 6))
    return st.library_papers(won, known_papers(spark, sf_dir), progress, "title").select("paper_id", "title", "percent")


@query(f"with {duck.WON}, {duck.PAPERS}, u as (select * from won where not deleted and event_type in ('view', 'click') order by updated_at desc, paper_id || '#intro' limit 12) select u.paper_id || '#intro' as id, p.title from u left join papers p on u.paper_id = 'u' || p.source_id")
def revisit_papers(spark, sf_dir):
    rows = st.latest(st.state_log(spark, sf_dir)).withColumn("id", F.concat("paper_id", F.lit("#intro")))
    rated = rows.withColumn("rating", F.when(F.col("event_type") == "view", "fuzzy").when(F.col("event_type") == "click", "lost"))
    return st.revisit_papers(rated, known_papers(spark, sf_dir)).select("id", "title")


@query(f"""with {duck.WON}, far as (select paper_id, max(least(value / 490, 1e0)) as far, round(arg_max(least(value / 490, 1e0), seq), 6) as percent from log group by 1)
select paper_id, case when deleted then 'unread' when far > 0.95 then 'finished' when far > 0.02 then 'reading' else 'unread' end as status, case when not deleted and far > 0.02 then 7 else updated_at end as updated_at, percent from won join far using (paper_id)""")
def progress_write(spark, sf_dir):
    """Every event moves its paper; entries that live are promoted, deleted ones stay."""
    log = st.state_log(spark, sf_dir)
    entries = st.latest(log).select("paper_id", F.lit("unread").alias("status"), "updated_at", "deleted")
    moves = log.select("paper_id", F.least(F.col("value") / 490, F.lit(1.0)).alias("percent"), F.lit(None).cast("int").alias("total"), "seq")
    none = spark.createDataFrame([], "paper_id string, percent double, total int, updated_at long, deleted boolean")
    progress, promoted = st.save_progress(none, entries, moves, 7)
    return promoted.join(progress.select("paper_id", F.round("percent", 6).alias("percent")), "paper_id").select("paper_id", "status", "updated_at", "percent")


@query(f"with {SIDES} select coalesce(l.paper_id, r.paper_id) as paper_id, case when r.paper_id is null then l.event_type when r.deleted then '' else r.event_type end as body, case when r.paper_id is null then l.deleted else r.deleted end as deleted from l full join r on l.paper_id = r.paper_id where l.paper_id is not null or not r.deleted")
def notes_save(spark, sf_dir):
    """The local side's notes after the remote side's bodies were saved, blank where its record is deleted."""
    local, remote = sides(spark, sf_dir)
    changes = remote.select("paper_id", F.when(F.col("deleted"), "  ").otherwise(F.col("event_type")).alias("body"))
    return st.save_notes(local.select("paper_id", F.col("event_type").alias("body"), "updated_at", "deleted"), changes, 7).select("paper_id", "body", "deleted")


@query(f"with {SIDES} select paper_id, seq, deleted from r union all select paper_id, seq, deleted from l where paper_id not in (select paper_id from r)")
def import_records(spark, sf_dir):
    """The remote side put over the local one, older or not."""
    return st.put(*sides(spark, sf_dir), "paper_id").select("paper_id", "seq", "deleted")


# Structure

def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered paper for every document: two sections whose lengths follow its number, an abstract, links and what is no part of it."""
    number = F.col("doc_id").cast("string")
    first, second = F.repeat(F.lit("word "), (F.col("doc_id") % 900 + 1).cast("int")), F.repeat(F.lit("more "), (F.col("doc_id") % 70 + 1).cast("int"))
    section = lambda at, head, body: F.concat(F.lit(f"<section id='S{at}' class='ltx_section'><h2 class='ltx_title ltx_title_section'><span class='ltx_tag'>{at}</span>"), head, F.lit("</h2><p>"), body, F.lit("</p></section>"))
    page = F.concat(
        F.lit("<html><body><nav><a href='/'>menu</a></nav><div class='ltx_page_main'><div class='ltx_abstract'><p> About "), number, F.lit(" </p></div>"),
        section(1, F.concat(F.lit("Head "), number), first), section(2, F.lit("Tail"), second),
        F.lit("<a href='#S1'>in</a><a href='p"), number, F.lit(".html'>out</a><img src='/static/x.png'><script>no</script></div></body></html>"),
    )
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("https://example.org/html/"), number).alias("url"), page.alias("html"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.structure(document_pages(spark, sf_dir))


N1, N2 = "(doc_id % 900 + 2)", "(doc_id % 70 + 1)"  # words of the sections: the heading runs into the first word
UNIT = "cast({0} as int) as words, cast(greatest(1, floor({0} / 180 + 0.5)) as int) as minutes, false as appendix"


@query(f"""select doc_id, '1-head-' || doc_id as key, 'S1' as element_id, case when {N1} < 350 then 'S2' else 'S1' end as end_element_id, '1 Head ' || doc_id as label, 1 as level, {UNIT.format(f"(case when {N1} < 350 then {N1} + {N2} else {N1} end)")}, case when {N1} < 350 then 1 else 0 end as merged, 0 as ordinal from documents
 union all select doc_id, '2-tail', 'S2', 'S2', '2 Tail', 1, {UNIT.format(N2)}, 0, 1 from documents where {N1} >= 350""")
def reading_units(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", F.explode("doc.units").alias("u")).select("doc_id", "u.*")


@query("select doc_id, 'S1' as id, '1Head ' || doc_id as label, 1 as level from documents union all select doc_id, 'S2', '2Tail', 1 from documents")
def html_toc(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", F.explode("doc.toc").alias("t")).select("doc_id", "t.id", "t.label", "t.level")


@query("select doc_id, true as available, 'About ' || doc_id as abstract from documents")
def html_abstract(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", F.col("doc").isNotNull().alias("available"), "doc.abstract")


@query("select doc_id, '1Head ' || doc_id || repeat('word ', doc_id % 900 + 1) || '2Tail' || repeat('more ', doc_id % 70 + 1) || 'inout' as text from documents")
def html_text(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", "doc.text")


@query("select doc_id, 0 as n, '#S1' as href, true as internal from documents union all select doc_id, 1, 'https://example.org/html/p' || doc_id || '.html', false from documents")
def html_links(spark, sf_dir):
    return described(spark, sf_dir).select("doc_id", F.posexplode("doc.links").alias("n", "l")).select("doc_id", "n", "l.href", "l.internal")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered paper of every document's text: a section, one with sections of equal names and sometimes prose of its own, and appendices."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    opened = lambda at, head, kind="section": F.lit(f"<section id='{at}' class='ltx_{kind}'>" + (f"<h2 class='ltx_title'>{head}</h2>" if head else "") + "<p>")
    closed, none = F.lit("</p></section>"), F.lit("")
    parts = [
        F.lit("<div class='ltx_page_main'>"), opened("S1", "Intro"), text, closed, opened("S2", "Body"), F.when(even, text).otherwise(none),
        opened("S3", "Data"), text, closed, opened("S4", "Data"), text, F.lit(" "), text, closed, F.lit("</section>"),
        *[F.when(third, x).otherwise(none) for x in (opened("A1", "", "appendix"), text, closed, opened("A2", "", "appendix"), text, closed)], F.lit("</div>"),
    ]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit("https://example.org/").alias("url"), F.concat(*parts).alias("html"))


COUNT = r"len(list_filter(regexp_split_to_array({0}, '[\s\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> ''))"
SECTION_UNITS = f"""with n as (select doc_id, {COUNT.format("'x' || coalesce(text, '')")} as n, {COUNT.format("'x' || coalesce(text, '') || ' ' || coalesce(text, '')")} as twice, {COUNT.format("coalesce(text, '')")} as m from documents),
p as (select *, doc_id % 2 = 0 and n >= 80 as intro from n),
u as (select doc_id, 1 as place, 'intro' as key, 'S1' as element_id, case when intro and n < 350 then 'S3' else 'S1' end as end_element_id, 'Intro' as label, 1 as level, case when intro and n < 350 then 2 * n else n end as words, false as appendix, case when intro and n < 350 then 1 else 0 end as merged from p
 union all select doc_id, 2, 'body', 'S2', 'S3', 'Body', 1, n, false, 0 from p where intro and n >= 350
 union all select doc_id, 3, 'data', 'S3', case when n < 350 then 'S4' else 'S3' end, 'Data', 2, case when n < 350 then n + twice else n end, false, case when n < 350 then 1 else 0 end from p
 union all select doc_id, 4, 'data-', 'S4', 'S4', 'Data', 2, twice, false, 0 from p where n >= 350
 union all select doc_id, 5, 'appendices', 'A1', 'A2', 'Appendices', 1, 2 * m, true, 0 from p where doc_id % 3 = 0)
select doc_id, case when place = 4 then key || rank else key end as key, element_id, end_element_id, label, level, cast(words as int) as words, cast(greatest(1, floor(words / 180 + 0.5)) as int) as minutes, appendix, merged, cast(rank - 1 as int) as ordinal
from (select *, row_number() over (partition by doc_id order by place) as rank from u)"""


@query(SECTION_UNITS)
def section_units(spark, sf_dir):
    """The reading units of every document's text as a page of sections."""
    return sr.reading_units(text_pages(spark, sf_dir)).select("doc_id", F.explode("units").alias("u")).select("doc_id", "u.*")


@query("""with d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
p as (select doc_id, length(text) as last, generate_subscripts(lines, 1) - 1 as ordinal, unnest(lines) as line from d),
s as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as start from p),
u as (select *, coalesce(lead(start) over (partition by doc_id order by ordinal), last) as stop from s),
e as (select event_id, user_id as doc_id, cast(floor(least(value / 490, 1e0) * (length(text) + 1)) as bigint) as position from events join d on user_id = d.doc_id)
select e.event_id, e.doc_id, max(ordinal) filter (where start <= least(position, last - 1) and stop > start) as current, cast(count(*) filter (where stop <= position) as bigint) as done, count(*) as total from e join u using (doc_id) group by 1, 2""")
def unit_positions(spark, sf_dir):
    """Where each event's reader is among the paragraphs of the document of their number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "line"))
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    starts = lines.select(F.col("doc_id").alias("paper"), "ordinal", F.col("ordinal").cast("string").alias("key"), F.coalesce(before, F.lit(0)).cast("long").alias("start"))
    ends = docs.select(F.col("doc_id").alias("paper"), F.length("text").cast("long").alias("end"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("paper"), F.least(F.col("value") / 490, F.lit(1.0)).alias("p"))
    at = events.join(ends, "paper").select("event_id", "paper", F.floor(F.col("p") * (F.col("end") + 1)).alias("position"))
    found = sr.reached(at, starts, ends)
    return found.select("event_id", F.col("paper").alias("doc_id"), F.col("current").cast("long").alias("current"), "done", "total")


@query()
def page_text(spark, sf_dir):
    """The cleaned text of every page; where the paper's marker is absent, of its body."""
    return sr.structure(spark.read.parquet(f"{sf_dir}/pages.parquet"), any_body=True).select("page_id", "doc.text")


@query("""with a as (select doc_id, text, substr(text, 11, 20) as exact, substr(text, 1, 10) as prefix, substr(text, 31, 32) as suffix from documents)
select doc_id, exact, prefix, suffix, case when exact <> '' then cast(instr(text, prefix || exact || suffix) + instr(prefix || exact || suffix, exact) - 2 as int) end as place from a""")
def quote_anchors(spark, sf_dir):
    """Each text's 20 characters from the tenth on, with what is around them, and where they are found again; short texts have a part, or none."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", sr.quote_anchor(F.col("text"), F.lit(10), F.lit(20)).alias("a"))
    return rows.select("doc_id", "a.exact", "a.prefix", "a.suffix", sr.locate(F.col("text"), F.col("a")).alias("place"))


# Streams


def streamed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state log as a stream of the ``events`` table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 0).alias("is_local"), (F.col("event_type") == "error").alias("deleted"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"), "event_type")


def new_state(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"


@query(f"with {duck.WON} select paper_id, seq, deleted, updated_at from won")
def stream_merge(spark, sf_dir):
    """A streamed log merged into a state by commits."""
    path = new_state(spark)
    streams.run_commits(streamed_log(spark, sf_dir), path, f"{path}-checkpoint")
    return commits.read(spark, path).select("paper_id", "seq", "deleted", "updated_at")


@query(f"with {duck.WON} select event_type as value, count(*) as n from won where not deleted group by 1")
def stream_tags(spark, sf_dir):
    """How many live records have which type: a view that follows the stream's commits."""
    path = new_state(spark)
    streams.run_commits(streamed_log(spark, sf_dir), path, f"{path}-checkpoint", views={"types": F.array("event_type")})
    return commits.read_view(spark, path, "types")


@query(f"with {duck.WON} select paper_id, seq, is_local, deleted from won where not deleted or (select max(updated_at) from log) - updated_at < 86400000")
def state_commits(spark, sf_dir):
    """Both sides of the state log committed, one after the other; old tombstones go."""
    path, (local, remote) = new_state(spark), sides(spark, sf_dir)
    now = st.state_log(spark, sf_dir).agg(F.max("updated_at")).first()[0] or 0
    commits.commit(spark, path, remote)
    merge = lambda new, old: st.prune(st.merge(new, old, "paper_id", "seq"), now, 86_400_000)
    commits.commit(spark, path, local, merge=merge)
    # The buckets that the second side didn't touch are pruned as well.
    return st.prune(commits.read(spark, path, local.schema), now, 86_400_000).select("paper_id", "seq", "is_local", "deleted")


@query("select event_type as set_name, cast(max(cast(ts as date)) as varchar) as resume_from, count(*) as n from events group by 1")
def stream_harvest(spark, sf_dir):
    """Events harvested as a feed with their type as the set: the log's rows by set, and the marks where each set resumes."""
    path, schema = new_state(spark), spark.read.parquet(f"{sf_dir}/events.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    rows = feed.select("event_id", F.col("event_type").alias("set_name"), F.col("ts").cast("date").cast("string").alias("datestamp"))
    streams.run_harvest(rows, f"{path}-log", path, f"{path}-checkpoint", "set_name")
    counts = spark.read.parquet(f"{path}-log").groupBy("set_name").agg(F.count("event_id").alias("n"))
    return commits.read(spark, path).join(counts, "set_name")


@query("with m as (select event_type as set_name, max(cast(ts as date)) as day from events group by 1) select event_id, event_type as set_name from events e left join m on e.event_type = m.set_name where cast(ts as date) >= coalesce(day, date '1970-01-01')")
def stream_bookmark(spark, sf_dir):
    """What a harvest reads again: from the latest day of each set on, that day included."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("set_name"), F.col("ts").cast("date").cast("string").alias("datestamp"))
    return streams.since_bookmark(events, streams.bookmark(events, "set_name"), "1970-01-01", "set_name").select("event_id", "set_name")


from . import library  # noqa: E402, F401  (registers its queries)
