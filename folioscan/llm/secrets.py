"""Secret scans over a trigram inverted index. DataFrame operations only on the main path.

Each rule's regular expression is read into a Boolean query of trigrams that every match must hold
(after Cox, 2012): an OR of ANDs. The index has postings (trigram, doc_id) of the trigrams that occur
in some query, over lower-cased texts; a clause's documents are those that all its postings share. A
rule runs on the documents of its query; a rule without mandatory trigrams runs on all. Matching is
exact: leftmost, non-overlapping, then a minimum length; a span is (kind, start, end) in code points,
end exclusive.

Only documents that satisfy some query are shuffled, to meet their kinds (see ``joins``).

Defined results: a null text is the empty one and has no span; rows of one doc_id share candidates,
each is matched by its own text; a row without doc_id is matched like the others; of the documents
the named columns are read and ``extra`` ones kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .joins import lookup

#: Strings, clauses and characters that a query may enumerate before it becomes weaker (never wrong).
MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of ``pattern`` has ``least`` characters or more. Java and Python read the pattern alike."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds, in their order, then further public token formats. In `access` and `hex`
# a minimum within the pattern is the same as dropping shorter matches, as these are maximal runs.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

Query = frozenset  # of clauses; a clause is a frozenset of trigrams. {frozenset()} is true of every text.
ANY = frozenset([frozenset()])


def minimal(query: Query) -> Query:
    """Without clauses that another clause implies."""
    return frozenset(c for c in query if not any(d < c for d in query))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return a if len(a) <= len(b) else b
    return minimal(frozenset(x | y for x in a for y in b))


def either(a: Query, b: Query) -> Query:
    out = minimal(a | b)
    return out if len(out) <= MOST else ANY


def of_strings(strings: set[str]) -> Query:
    return minimal(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def analyse(node) -> tuple[set[str] | None, Query]:
    """What a parsed expression matches: all its strings if few, else None; and its trigram query."""
    run, query, exact = {""}, ANY, True
    for op, arg in node:
        strings, inner = None, ANY
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            strings = in_set(arg)
        elif op is C.SUBPATTERN:
            strings, inner = analyse(arg[3])
        elif op is C.BRANCH:
            strings, inner = set(), frozenset()
            for s, q in map(analyse, arg[1]):
                inner = either(inner, of_strings(s) if s is not None else q)
                strings = strings | s if strings is not None and s is not None else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            s, q = analyse(sub)
            if s is not None and high <= 1:
                strings = s | {""} if low == 0 else s
            elif low:
                inner = of_strings(s) if s is not None else q
        elif op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
        else:
            query = both(both(query, of_strings(run)), of_strings(strings) if strings else inner)
            run, exact = {""}, False
    return (run, ANY) if exact else (None, both(query, of_strings(run)))


def in_set(parts) -> set[str] | None:
    out: set[str] = set()
    for op, arg in parts:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < MOST // 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST // 4 else None


def trigram_query(pattern: str) -> Query:
    """The Boolean query that the lower-cased text of any match satisfies."""
    strings, query = analyse(parser.parse(pattern))
    return of_strings(strings) if strings is not None else query


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index (trigram, doc_id), of the given trigrams, over lower-cased texts."""
    lowered = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("x"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("x"), t))
    return lowered.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame | None, list[str]]:
    """((doc_id, kinds): the rules whose query a document satisfies; the kinds that run on every document)."""
    spark = docs.sparkSession
    clauses, full = [], []
    for r in rules:
        query = trigram_query(r.pattern)
        if frozenset() in query:
            full.append(r.kind)
        else:
            clauses += [(r.kind, f"{r.kind}{k}", t, len(c)) for k, c in enumerate(sorted(map(sorted, query))) for t in c]
    if not clauses:
        return None, full
    table = F.broadcast(spark.createDataFrame(clauses, "kind string, clause string, trigram string, terms int"))  # a row for each trigram of a rule
    index = postings(docs, sorted({c[2] for c in clauses}), key, text)
    met = index.join(table, "trigram").groupBy("doc_id", "kind", "clause", "terms").agg(F.count_distinct("trigram").alias("n")).filter("n = terms")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), full


EMPTY = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"
#: Matches that are walked in one go; a longer list is walked in parts, so that its cost stays linear.
WALKED = 256


def spans(rule: Rule, order: int, text: Column) -> Column:
    """All spans of a rule in a text: the pieces between matches tell where these begin."""
    found, between = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    own = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    size = lambda b, f, t: F.struct(F.length(b).alias("b"), F.length(f).alias("f"), F.length(t).alias("t"))
    each = F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f"), own.alias("t")), lambda m: size(m["b"], m["f"], m["t"]))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["b"]
        end = start + m["f"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["t"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def walked(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.expr(EMPTY).alias("out")), step, lambda acc: acc["out"])

    def apart(each: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(each), F.lit(WALKED)), lambda k: F.slice(each, k, WALKED))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, F.slice(begins(ps), 1, F.size(ps)), walked)))

    def begins(parts: Column) -> Column:
        """Where each part begins: the sums of the parts before it."""
        long = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, m: n + m["b"] + m["f"]))
        return F.aggregate(long, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    told = let(each, lambda ms: F.when(F.size(ms) <= WALKED, walked(ms, F.lit(0))).otherwise(apart(ms)))
    return F.when(F.rlike(text, F.lit(rule.pattern)), told).otherwise(F.expr(EMPTY))


def scan(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (doc_id, x, spans), ``x`` the text and ``spans`` (start, rank, kind, end) in order."""
    held, full = candidates(docs, rules, key, text)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x"), *[F.col(c) for c in extra])

    def told(rows: DataFrame, some: bool) -> DataFrame:
        found = [spans(r, k, F.col("x")) if r.kind in full else F.when(F.array_contains("kinds", r.kind), spans(r, k, F.col("x"))).otherwise(F.expr(EMPTY)) for k, r in enumerate(rules) if some or r.kind in full]
        rows = rows.select("doc_id", "x", *extra, *[e.alias(f"_s{k}") for k, e in enumerate(found)])
        return rows.select("doc_id", "x", *extra, F.array_sort(F.concat(F.expr(EMPTY), *[F.col(f"_s{k}") for k in range(len(found))])).alias("spans"))

    if held is None:
        return told(rows, False)
    plain, others = lookup(rows, ["doc_id"], stored(held, "candidates"))
    return told(plain, False).unionByName(told(others, True))


def written(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``; overlapping or touching spans are one stretch.

    With starts and ends sorted apart, stretches part where the k-th smallest end lies before the next start. What is
    between them is cut out of the text's UTF-32 form, in which places are found without counting.
    """
    a, b = F.array_sort(F.transform(found, lambda s: s["start"])), F.array_sort(F.transform(found, lambda s: s["end"]))
    bound = F.struct(a.alias("a"), b.alias("b"), F.encode(text, "UTF-32").alias("wide"))

    def pieces(v: Column) -> Column:
        n = F.size(v["a"]) - 1
        gaps = F.filter(F.arrays_zip(F.slice(v["b"], 1, n).alias("b"), F.slice(v["a"], 2, n).alias("a")), lambda g: g["b"] < g["a"])
        kept = F.concat(F.array(F.struct(F.lit(0).alias("b"), F.get(v["a"], F.lit(0)).alias("a"))), gaps, F.array(F.struct(F.element_at(v["b"], -1).alias("b"), (F.octet_length(v["wide"]) / 4).cast("int").alias("a"))))
        # A character before each piece, taken off again, as a decoder drops a byte order mark that comes first.
        return F.transform(kept, lambda g: F.substring(F.decode(F.concat(F.unhex(F.lit("00000078")), F.substring(v["wide"], g["b"] * 4 + 1, (g["a"] - g["b"]) * 4)), "UTF-32"), 2, 2147483647))

    return F.when(F.size(found) > 0, let(bound, lambda v: F.array_join(pieces(v), mark))).otherwise(text)
