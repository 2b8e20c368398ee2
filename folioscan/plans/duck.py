"""DuckDB SQL for the oracle side: the papers view, terms, postings and search, written for that dialect."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.papers import CATEGORIES

SCOPE = "['cs.AI','cs.LG','cs.CL','cs.CV','cs.NE','stat.ML']"


def case(expr: str) -> str:
    return "case " + expr + " " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(CATEGORIES)) + " end"


A, B = case("doc_id % 8"), case("(doc_id // 8) % 8")

PAPERS = f"""src as (select doc_id, text, lang, source, cast(date '2017-01-01' + cast((doc_id*37)%3500 as int) as varchar) as published,
 substr(split_part(text, chr(10), 1), 1, 120) as title from documents),
papers as (select doc_id as source_id, concat(substr(published,3,2), substr(published,6,2), '.', lpad(cast(doc_id as varchar),5,'0')) as id, title,
 trim(substr(text, length(title)+1)) as abstract, list_value(source, lang) as authors,
 case when {A} = {B} then list_value({A}) else list_value({A}, {B}) end as categories, published,
 cast(date '2017-01-01' + cast((doc_id*37)%3500 + (doc_id%3)*30 as int) as varchar) as updated from src)"""

DOCS = f"""{PAPERS}, docs as (select row_number() over (order by published desc, id desc) - 1 as doc_id, source_id, id, title, abstract, authors, categories, published,
 nullif(updated, published) as updated from papers where list_has_any(categories, {SCOPE}))"""


def terms(e: str, stop: bool = False) -> str:
    """A list of index terms of a text expression."""
    folded = f"regexp_replace(lower(strip_accents({e})), '[‐-―−]', '-', 'g')"
    raw = f"list_filter(regexp_split_to_array({folded}, '[^a-z0-9+#-]+'), lambda x: x <> '')"
    parts = "list_filter(string_split(x, '-'), lambda p: p <> '')"
    every = f"flatten(list_transform({raw}, lambda x: case when not contains(x, '-') then [x] when len({parts}) < 2 then [replace(x, '-', '')] else list_concat([array_to_string({parts}, '')], {parts}) end))"
    number = "(regexp_full_match(t, '[0-9]+') and not (length(t) = 4 and t >= '1900'))"
    words = " and not list_contains([" + ",".join(f"'{w}'" for w in STOPWORDS) + "], t)" if stop else ""
    return f"list_filter({every}, lambda t: length(t) between 2 and 32 and not {number}{words})"


STATS = f"""stats as (select count(*) as n, coalesce(nullif(avg(len({terms('title')})),0),1) as a1, coalesce(nullif(avg(len({terms("array_to_string(authors,' ')")})),0),1) as a2,
 coalesce(nullif(avg(len(categories)),0),1) as a4, coalesce(nullif(avg(len({terms('abstract', True)})) filter (where abstract <> ''),0),1) as a8,
 max(published) as newest, min(published) as oldest, count(*) filter (where abstract <> '') as abstract_docs from docs)"""

POSTINGS = f"""{DOCS}, {STATS}, f as (
 select doc_id, 1 as field, {terms('title')} as t from docs union all
 select doc_id, 2, {terms("array_to_string(authors,' ')")} from docs union all
 select doc_id, 4, list_transform(categories, lambda c: lower(c)) from docs union all
 select doc_id, 8, {terms('abstract', True)} from docs),
tf as (select doc_id, field, term, count(*) as tf, any_value(l) as l from (select doc_id, field, len(t) as l, unnest(t) as term from f) group by all),
w as (select doc_id, field, term, case field when 1 then 3.2 when 2 then 2.4 when 4 then 1.6 else 1.0 end
 * (tf * 2.2e0) / (tf + 1.2e0 * (1 - 0.65e0 + 0.65e0 * l / case field when 1 then a1 when 2 then a2 when 4 then a4 else a8 end)) as w from tf, stats),
post as (select term, doc_id, bit_or(field) as mask, greatest(1, cast(floor(least(sum(w), 24e0) / 24 * 255 + 0.5e0) as int)) as weight from w group by all),
df as (select term, count(*) as df from post group by 1)"""

IDF = "greatest(0.05e0, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)))"
OUT = "rank, doc_id, id, title, published, score, matched_fields"


def search(slots: list[tuple[int, str, int]], negated: tuple[str, ...] = (), where: str = "true", sort: str = "", offset: int = 0, limit: int = 25, expand: dict[int, str] | None = None) -> str:
    """A page of a search: slots of (slot, term, fields); ``expand`` gives a slot a prefix instead."""
    return f"""with {hits(slots, negated, where, expand)} select row_number() over (order by {sort} score desc, raw desc, doc_id) as rank, doc_id, id, title, published, round(score, 6) as score, mask as matched_fields
 from hits order by {sort} score desc, raw desc, doc_id limit {limit} offset {offset}"""


def hits(slots, negated=(), where="true", expand=None) -> str:
    values = ", ".join(f"({k}, '{t}', {f})" for k, t, f in slots)
    wanted = f"slots as (select * from (values {values}) as v(slot, term, fields))"
    if expand:
        more = " union all ".join(f"(select {k} as slot, term, 0 as fields from df where starts_with(term, '{p}') order by term <> '{p}', term limit 24)" for k, p in expand.items())
        wanted = "slots as (" + (f"select * from (values {values}) as v(slot, term, fields) union all " if values else "") + more + ")"
    gone = " and doc_id not in (select doc_id from post where term in (" + ",".join(f"'{t}'" for t in negated) + "))" if negated else ""
    k = len({s[0] for s in slots} | set(expand or {}))
    return f"""{POSTINGS}, {wanted},
scored as (select doc_id, round(sum({IDF} * (weight / 255e0 * 24)), 9) as raw, bit_or(mask) as mask from post join slots using (term) join df using (term), stats
 where fields = 0 or mask & fields <> 0 group by doc_id having count(distinct slot) = {k}),
best as (select * from scored where true{gone} order by raw desc, doc_id limit 4000),
hits as (select b.doc_id, id, title, published, raw, mask, round(raw * case when date_diff('day', cast(published as date), cast(newest as date)) >= 0
 then 1 + 0.35e0 * exp(-(date_diff('day', cast(published as date), cast(newest as date)) / 365.25e0) / 6) else 1 end, 9) as score
 from best b join docs using (doc_id), stats where {where})"""


# A log of queries over the benchmark's neighbouring words, its slots written down as each form means them.
LOG_HITS = f"""{POSTINGS}, b as (select item_id, text, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark),
ql as (select item_id * 100000 + k as query_id, (item_id + k) % 6 as kind, lower(w[k]) as a, lower(w[k + 1]) as c, w[k] || ' ' || w[k + 1] as neighbours from (select item_id, w, unnest(range(1, len(w))) as k from b)),
slots as (select query_id, 0 as slot, a as term, case when kind in (2, 4) then 1 else 0 end as fields from ql where length(a) between 2 and 32
 union all select query_id, 1, c, case when kind = 4 then 1 else 0 end from ql where kind not in (1, 5) and length(c) between 2 and 32
 union all select item_id * 100000, i, term, 0 from (select item_id, unnest({terms('text')}) as term, generate_subscripts({terms('text')}, 1) as i from b)),
k as (select query_id, count(*) as k from slots group by 1),
scored as (select query_id, doc_id, round(sum({IDF} * (weight / 255e0 * 24)), 9) as raw, bit_or(mask) as mask from post join slots using (term) join df using (term) join k using (query_id), stats
 where (fields = 0 or mask & fields <> 0) and not exists (select 1 from ql join post p on p.term = ql.c where ql.query_id = slots.query_id and kind = 1 and length(c) between 2 and 32 and p.doc_id = post.doc_id)
 group by query_id, doc_id, k having count(distinct slot) = k),
best as (select * from scored qualify row_number() over (partition by query_id order by raw desc, doc_id) <= 4000),
hits as (select b.query_id, b.doc_id, id, title, published, raw, mask, round(raw * case when date_diff('day', cast(published as date), cast(newest as date)) >= 0
 then 1 + 0.35e0 * exp(-(date_diff('day', cast(published as date), cast(newest as date)) / 365.25e0) / 6) else 1 end, 9) as score
 from best b join docs using (doc_id) left join ql using (query_id), stats
 where (kind is null or kind <> 5 or list_contains(categories, 'cs.LG')) and (kind is null or kind <> 4 or length(a) < 2 or length(c) < 2 or contains(lower(strip_accents(title)), lower(neighbours)))),
idle as (select query_id, kind = 5 as narrow from ql where query_id not in (select query_id from k) union all select item_id * 100000, false from b where item_id * 100000 not in (select query_id from k)),
shelf as (select doc_id, id, title, published, list_contains(categories, 'cs.LG') as lg, row_number() over (order by doc_id) as r, row_number() over (partition by list_contains(categories, 'cs.LG') order by doc_id) as rl from docs),
page as (select query_id, rank, doc_id, id, title, published, round(score, 6) as score, mask as matched_fields from (select *, row_number() over (partition by query_id order by score desc, raw desc, doc_id) as rank from hits) where rank <= 10
 union all select query_id, case when narrow then rl else r end, doc_id, id, title, published, 0e0, 0 from idle join shelf on case when narrow then lg and rl <= 10 else r <= 10 end)"""

LOG = """log as (select 'u' || user_id as paper_id, event_id as seq, event_id % 2 = 0 as is_local, event_type = 'error' as deleted, epoch_us(ts) // 1000 as updated_at, event_type, value from events)"""
WON = f"{LOG}, won as (select * from log qualify row_number() over (partition by paper_id order by updated_at desc, is_local desc, seq desc) = 1)"
