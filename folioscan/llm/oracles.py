"""DuckDB SQL of the registered queries that SQL can express, from their contracts and by other means than theirs."""

from __future__ import annotations

from . import chat, secrets

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# A turn is escaped if its own closing string, or another turn's opening, stands in it, or a control string with backslashes.
CONTROL = quoted(chat.CONTROL.pattern)
OTHER = len(chat.BOS + chat.SYS + chat.BAR + chat.ENDSYS)
OP3 = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(k, r)),
c as (select *, case role when 'user' then {quoted(chat.CLOSE)} when 'assistant' then {quoted(chat.EOS)} else {quoted(chat.ENDSYS)} end as tail,
 case role when 'user' then {len(chat.BOS + chat.OPEN + chat.CLOSE)} when 'assistant' then {len(chat.BOS + chat.EOS)} else {OTHER} + length(role) end as frame from t),
e as (select *, instr(text || tail, tail) <= length(text) or role = 'assistant' and (starts_with(text, {quoted(chat.OPEN)}) or starts_with(text, {quoted(chat.SYS)}))
 or len(list_filter(regexp_extract_all(text, {CONTROL}, 2), lambda x: x <> '')) > 0 as escaped from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(frame + length(text) + case when escaped then len(regexp_extract_all(text, {CONTROL})) else 0 end) as bigint) as formatted_chars from e group by conv_id"""

# Runs of consecutive item words that stand on one diagonal (document place less item place); near ones within one word of it.
WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP6 = f"""with d as (select doc_id, regexp_extract_all({LOWERED}, {WORD}) as w from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all({LOWERED}, {WORD}) as w from benchmark where item_id is not null),
dw as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as p from d),
iw as (select item, len(w) as n, unnest(w) as term, generate_subscripts(w, 1) as j from i where len(w) > 0),
m as (select doc_id, item, n, j, p - j as delta from dw join iw using (term)),
g as (select *, j - row_number() over (partition by doc_id, item, delta order by j) as g from m),
r as (select doc_id, item, delta, min(j) as a, max(j) as b from g group by doc_id, item, delta, n, g having count(*) >= least(10, n)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(delta + a, delta + b + 1)) as p from r) group by doc_id),
near as (select distinct doc_id, item, n, j, delta + s as delta from m, (values (-1), (0), (1)) as v(s)),
ng as (select *, j - row_number() over (partition by doc_id, item, delta order by j) as g from near),
nr as (select distinct doc_id, item from (select doc_id, item from ng group by doc_id, item, delta, n, g having count(*) >= least(10, n))),
exact as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from r) group by doc_id),
close as (select doc_id, string_agg(item, ',' order by item) as items from nr group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(e.items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(c.items, '') as near_items
 from d left join hit using (doc_id) left join exact e using (doc_id) left join close c using (doc_id)"""


def found(rule: secrets.Rule, rank: int) -> str:
    """The spans of a rule: what lies between matches, and the matches before, tell where each begins."""
    p = quoted(rule.pattern)
    x = "coalesce(text, '')"
    before = "list_sum(list_transform(list_slice(b, 1, i), lambda z: length(z))) + coalesce(list_sum(list_transform(list_slice(f, 1, i - 1), lambda z: length(z))), 0)"
    return f"""select doc_id, cast({before} as bigint) as a, {rank} as rank, '{rule.kind}' as kind, cast({before} as bigint) + length(f[i]) as z from (select *, unnest(range(1, len(f) + 1)) as i
 from (select doc_id, regexp_extract_all({x}, {p}) as f, regexp_extract_all({x}, {p}, {rule.group}) as t, regexp_split_to_array({x}, {p}) as b from documents)) where length(t[i]) >= {rule.least}"""


BASE = ", ".join(quoted(r.kind) for r in secrets.RULES if r.base)
OP7 = f"""with s as ({" union all ".join(found(r, k) for k, r in enumerate(secrets.RULES))}),
o as (select doc_id, {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.RULES if r.base)},
 string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) filter (where kind in ({BASE})) as base, string_agg(kind || ':' || a || ':' || z, ',' order by a, rank) as spans from s group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.RULES if r.base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join o using (doc_id)"""

OP8 = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
r as (select doc_id, doc_id as o from d union select r.doc_id, e.b from r join e on r.o = e.a)
select doc_id, coalesce(n, 0) as n_shingles, c as component_id, doc_id = c as kept from (select doc_id, min(o) as c from r group by 1) left join n using (doc_id)"""

OP10 = """with p as (select page_id, encode(coalesce(html, '')) as h from pages), d as (select page_id, sha1(h) as s, octet_length(h) as n from p),
g as (select s, n, max(page_id) as first from d where n >= 1000 group by all)
select page_id, n as payload_bytes, s as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to from d left join g using (s, n)"""

# Every group by every kept term, in 128-bit integers.
SHARE = "1 + (1000000000::hugeint * ({0} + 2)) // ({1} + 2 * v)"
OP11 = rf"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as ln from t group by all having count(distinct r) >= 10),
l as (select lang, count(*) as v, sum(ln) as nl from k group by 1),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(any_value(v), 0) as v, coalesce(any_value(nl), 0) as nl, coalesce(sum(n), 0) as nn from (select distinct lang, source from d) left join l using (lang) left join c using (lang, source) group by all),
p as (select lang, source, term, coalesce(n, 0) as n, {SHARE.format("coalesce(n, 0)", "nn")} as p, {SHARE.format("ln", "nl")} as q from g join k using (lang) left join c using (lang, source, term)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
 union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u) where part = 'pair' or rank <= 10"""

# CRC-32 by its table, which comes from the polynomial; near words by what deletions at the same place, or at any, leave.
STEP = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
OP12 = rf"""with recursive b as (select range as k, range as c, 0 as i from range(256) union all select k, {STEP.format("c")}, i + 1 from b where i < 8),
tab as (select list(c order by k) as t from b where i = 8),
x as (select doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents),
y as (select doc_id, run, count(*) as c from x where length(run) >= 6 group by all),
z as (select run, c, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda s: cast('0x' || s as bigint))),
 lambda a, s: xor(a >> 8, t[(xor(a, s) & 255) + 1])), 4294967295) as h from y, tab),
r as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from z),
w as (select word, cast(sum(c) as bigint) as n from r where length(word) >= 6 group by 1 having sum(c) >= 5),
del as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as less from (select *, unnest(range(length(word))) as i from w)),
near as (select distinct a.word, a.n, b.word as near, b.n as m from del a join del b on a.less = b.less and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
 union select distinct a.word, a.n, b.word, b.n from del a join w b on a.less = b.word union select distinct b.word, b.n, a.word, a.n from del a join w b on a.less = b.word),
best as (select word, any_value(n) as n, count(*) as n_near, arg_min(near, (-m, near)) as form, max(m) as m from near group by 1),
form as (select word, form, m from best where m >= 5 * n),
path as (select word, word as root from w union all select path.word, form.form from path join form on path.root = form.word),
root as (select word, root from path where root not in (select word from form))
select w.word, form.form, root, n, coalesce((select n_near from best where best.word = w.word), 0) as n_near, form.m as form_n from w join root using (word) left join form using (word)"""

ORACLES = {"op3_chat": OP3, "op6_decontamination": OP6, "op7_secrets": OP7, "op8_near_duplicates": OP8, "op10_warc": OP10, "op11_divergence": OP11, "op12_variants": OP12}
