"""Whole tables of queries and of seeds, each in one pass over the index.

A query log is parsed by column functions, one row a query, with the rules of ``search.parse_query``. Its ranked
queries meet the index in groups, a span of its zones at a time: a document is a candidate of the queries whose rarest term it has,
and the other terms are looked up among the span's postings. So frequent terms, which most documents have, multiply nothing, and of a
query with many hits only those are made that may be among its candidates.

Related papers of every paper: the terms that mark a paper are chosen within its row, and groups of papers meet the postings of
their terms, a span of documents at a time. Pairs of papers never leave the task that makes them, but for a span's best.

Defined results: a null query is an empty one; queries without a positive term browse by their categories, empty ones
all papers; rows that repeat an identifier are queries of their own only if their texts are the same, so identifiers should
be unique. An empty table of queries gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import discard, shared_dir, shuffles_removed, stored
from .index import ABSTRACT, CEILING, MASK_BITS, TITLE, WEIGHT_BITS, Index, idf, numbered, weight_of
from .search import CANDIDATES, FIELDS, RELATED_FLOOR, RELATED_LEAST, RELATED_LENGTH, RELATED_MOST, RELATED_TERMS, Filters, at_chunks, passes, recency

WHITE = r"\s\x1c-\x1f\u0085   -     　"
MINUS, FIELD = rf"(-(?=[^{WHITE}]))?", rf"(?:({'|'.join([*FIELDS, 'cat'])}):)?"
#: A token as ``search.TOKEN`` has it: groups of the minus, the field, the quoted text with its quotes, the bare text.
TOKEN = rf'(?i){MINUS}{FIELD}(?:("[^"]*(?:"|\z))|([^{WHITE}]*))'
TERM = "array<struct<term: string, fields: int, negated: boolean>>"


def parsed(query: Column) -> Column:
    """(terms, categories, phrases) of a query: ``search.parse_query`` as a column, without prefixes.

    ``terms`` are (term, fields, negated) in order with repeats; ``phrases`` those of quoted title terms, which titles must hold.
    """
    token = lambda t, g: F.regexp_extract(t, TOKEN, g)
    found = F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: t != "")
    cut = lambda t: F.regexp_replace(token(t, 3), '^"|"$', "")

    def read(t: Column) -> Column:
        quoted = token(t, 3) != ""
        text = F.when(quoted, cut(t)).otherwise(token(t, 4))
        return F.struct(text.alias("text"), quoted.alias("quoted"), F.lower(token(t, 2)).alias("field"), (token(t, 1) != "").alias("negated"), tx.terms(text).alias("parts"))

    tokens = F.filter(F.transform(found, read), lambda t: t["text"] != "")
    fields = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    field = lambda t: F.coalesce(F.try_element_at(fields, t["field"]), F.lit(0))
    plain, asked = F.filter(tokens, lambda t: t["field"] != "cat"), F.filter(tokens, lambda t: t["field"] == "cat")
    terms = F.flatten(F.transform(plain, lambda t: F.transform(t["parts"], lambda x: F.struct(x.alias("term"), field(t).alias("fields"), t["negated"].alias("negated")))))
    bound = F.filter(plain, lambda t: t["quoted"] & ~t["negated"] & (F.size(t["parts"]) > 1) & (field(t) == TITLE))
    return F.struct(terms.cast(TERM).alias("terms"), F.transform(asked, lambda t: F.lower(t["text"])).alias("categories"), F.transform(bound, lambda t: t["text"]).alias("phrases"))


def asked_terms(index: Index, queries: DataFrame, doc_count: int) -> tuple[DataFrame, DataFrame]:
    """The ranked queries' (query_id, pivot, slots, banned), and (term, number, df, pivot) of all terms that they have; slots name terms by number.

    ``pivot`` is a query's rarest positive term; a query of which some positive term is in no document has no hits and goes.
    """
    each = queries.select("query_id", F.posexplode("q.terms").alias("slot", "t")).select("query_id", "slot", "t.*")
    numbers = stored(numbered(each.select("term").distinct().join(index.terms, "term"), F.asc("term")), "asked")
    known = each.join(numbers, "term", "left")
    gathered = known.groupBy("query_id").agg(
        F.min(F.when(~F.col("negated"), F.coalesce("df", F.lit(0)))).alias("least"),
        F.min_by("number", F.when(~F.col("negated"), F.struct("df", "slot"))).alias("pivot"),
        F.array_sort(F.collect_list(F.when(~F.col("negated"), F.struct("slot", "number", "fields", idf(F.col("df"), F.lit(doc_count)).alias("idf"))))).alias("slots"),
        F.collect_set(F.when(F.col("negated"), F.col("number"))).alias("banned"),
    )
    ranked = stored(gathered.filter("least > 0").drop("least"), "queries")
    wanted = ranked.select("pivot", F.explode(F.array_union(F.transform("slots", lambda s: s["number"]), "banned")).alias("number"))
    wanted = wanted.groupBy("number").agg(F.max(F.col("number") == F.col("pivot")).alias("pivot"))
    return ranked, stored(numbers.select("term", "number", "df").join(wanted, "number"), "wanted")


#: Queries and zones that meet in a task; steps of a query's scores by which its last candidate is bounded.
GROUP, SPAN, SCORE_STEPS = 2048, 8, 256
MET = "doc_id long, score double, mask int"


def hits_of(postings: pa.Table, queries: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
    """(place, documents, scores, masks, largest possible score) of each of some queries, over the postings of some zones.

    Terms are met in the order of a query's slots, so that scores are summed in one order everywhere.
    """
    packed = postings.column("packed").combine_chunks()
    size, values = pc.list_value_length(packed).to_numpy(), packed.flatten().to_numpy()
    number, first = (np.repeat(postings.column(c).to_numpy(), size) for c in ("number", "first"))
    doc = first + (values >> (WEIGHT_BITS + MASK_BITS))
    order = np.lexsort((doc, number))
    doc, held, number = doc[order], (values & ((1 << (WEIGHT_BITS + MASK_BITS)) - 1))[order], number[order]
    known, start = np.unique(number, return_index=True)
    of_term = dict(zip(known.tolist(), zip(start.tolist(), np.append(start[1:], len(doc)).tolist())))
    slots, banned = (queries.column(c).combine_chunks() for c in ("slots", "banned"))
    parts = slots.flatten()
    numbers, fields, idfs = (parts.field(c).to_pylist() for c in ("number", "fields", "idf"))
    gone, ends = banned.flatten().to_pylist(), [np.append(0, np.cumsum(pc.list_value_length(x).to_numpy())).tolist() for x in (slots, banned)]

    def looked_up(term: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which documents have a term, and what they hold of it."""
        low, high = of_term.get(term, (0, 0))
        if low == high:
            return np.zeros(len(docs), bool), np.zeros(len(docs), np.int64)
        at = low + np.minimum(np.searchsorted(doc[low:high], docs), high - low - 1)
        return doc[at] == docs, held[at]

    for k, pivot in enumerate(queries.column("pivot").to_pylist()):
        low, high = of_term[pivot]
        docs, score, mask, top = doc[low:high], np.zeros(high - low), np.zeros(high - low, np.int64), 0.0
        for j in range(ends[0][k], ends[0][k + 1]):
            has, x = looked_up(numbers[j], docs)
            if fields[j]:
                has &= (x >> WEIGHT_BITS) & fields[j] != 0
            x, docs = x[has], docs[has]
            score, mask, top = score[has] + idfs[j] * weight_of(x & ((1 << WEIGHT_BITS) - 1)), mask[has] | x >> WEIGHT_BITS, top + idfs[j] * CEILING
        for term in gone[ends[1][k] : ends[1][k + 1]]:
            free = ~looked_up(term, docs)[0]
            docs, score, mask = docs[free], score[free], mask[free]
        yield k, docs, score, mask, top


def met(postings: pa.Table, queries: pa.Table) -> pa.Table:
    """The hits whose scores reach their query's ``floor``."""
    places, found = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    floors = queries.column("floor").to_pylist()
    for k, docs, score, mask, _ in hits_of(postings, queries) if len(queries) and len(postings) else ():
        if floors[k] is not None:
            high = score >= floors[k]
            docs, score, mask = docs[high], score[high], mask[high]
        places.append(np.full(len(docs), k))
        found.append((docs, score, mask))
    docs, score, mask = (np.concatenate([f[k] for f in found]) for k in range(3))
    ids = queries.column("query_id").take(pa.array(np.concatenate(places)))
    return pa.table([ids, pa.array(docs, pa.int64()), pa.array(score), pa.array(mask, pa.int32())], ["query_id", "doc_id", "score", "mask"])


def score_counts(postings: pa.Table, queries: pa.Table) -> pa.Table:
    """(query_id, low, n): how many hits of a query lie in each step of its scores, which begins at ``low``."""
    places, lows, sizes = [], [], []
    for k, _, score, _, top in hits_of(postings, queries) if len(queries) and len(postings) else ():
        counts = np.bincount((score / top * SCORE_STEPS).astype(np.int64))
        some = np.flatnonzero(counts)
        places += [k] * len(some)
        lows += (some * (top / SCORE_STEPS)).tolist()
        sizes += counts[some].tolist()
    ids = queries.column("query_id").take(pa.array(places, pa.int64()))
    return pa.table([ids, pa.array(lows, pa.float64()), pa.array(sizes, pa.int64())], ["query_id", "low", "n"])


def candidates(index: Index, ranked: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, mask): all hits of a query with up to ``CANDIDATES`` of them; of others, all that can be among the
    first ``CANDIDATES``, and more than so many.

    Groups of queries meet the postings of their terms in spans of zones. Where a query's rarest term has more documents than may
    compete, its hits are first counted by steps of the score: what lies below the step that holds the last candidate is never made.
    """
    groups = max(1, -(-ranked.count() // GROUP))
    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = terms.withColumn("shard", tx.shard_key(F.col("term"), index.config.prefix_length))
    span = F.floor(F.col("zone") / SPAN).cast("int").alias("span")
    spans = index.blocks.join(asked.filter("pivot"), ["shard", "term"]).select(F.col("number").alias("pivot"), span).distinct()

    def meet(queries: DataFrame, f, kinds: str) -> DataFrame:
        wanted = queries.select("part", F.explode(F.array_union(F.transform("slots", lambda s: s["number"]), "banned")).alias("number")).distinct().join(asked, "number")
        postings = index.blocks.join(wanted, ["shard", "term"]).select(F.col("part").alias("group"), span, "number", "first", "packed")
        kind = queries.schema["query_id"].dataType.simpleString()
        return postings.groupBy("group", "span").cogroup(queries.join(spans, "pivot").groupBy("part", "span")).applyInArrow(f, f"query_id {kind}, {kinds}")

    large = stored(dealt.join(terms.filter(F.col("pivot") & (F.col("df") > CANDIDATES)).select(F.col("number").alias("pivot")), "pivot", "left_semi"), "large")
    if large.isEmpty():
        found = meet(dealt.withColumn("floor", F.lit(None).cast("double")), met, MET)
    else:
        steps = meet(large, score_counts, "low double, n long").groupBy("query_id", "low").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("low")))  # SCORE_STEPS rows of a query
        last = steps.withColumn("above", above).filter(F.col("above") > CANDIDATES).groupBy("query_id").agg(F.max("low").alias("low"))
        # Scores are rounded to 1e-9 later: what rounds to the step's first score stays.
        floors = stored(last.select("query_id", (F.col("low") - 1e-8).alias("floor")), "floors")
        found = meet(dealt.join(floors, "query_id", "left"), met, MET)
    return found.withColumn("score", F.round("score", 9))


def resolved(index: Index, scored: DataFrame, queries: DataFrame, filters: Filters) -> DataFrame:
    """The hits among the best scored documents of each query, with what orders them; titles are read, but go no further."""
    newest = index.manifest.first()["newest"]
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("k") <= CANDIDATES).drop("k")
    asked = queries.select("query_id", F.col("q.categories").alias("wanted"), "q.phrases")
    docs = index.docs.select("chunk", "doc_id", "title", "published", "categories")
    hits = docs.join(at_chunks(index, best.join(asked, "query_id")), ["chunk", "doc_id"]).filter(passes(Filters(since=filters.since, until=filters.until), ()))
    wanted = F.concat("wanted", F.array(*[F.lit(c.lower()) for c in filters.categories]).cast("array<string>"))
    title = tx.fold(F.col("title"))
    hits = hits.filter((F.size(wanted) == 0) | F.arrays_overlap(F.transform("categories", F.lower), wanted)).filter((F.size("phrases") == 0) | F.forall("phrases", lambda p: F.contains(title, tx.fold(p))))
    boosted = F.round(F.col("score") * recency(F.col("published"), F.lit(newest)), 9)
    return hits.select("query_id", "chunk", "doc_id", "published", boosted.alias("score"), F.col("score").alias("raw_score"), F.col("mask").alias("matched_fields"))


def browsed(index: Index, queries: DataFrame, filters: Filters, limit: int) -> DataFrame:
    """Pages of the queries that browse: the first papers of any of their categories.

    The first ``limit`` papers of every category are enough for any union of categories.
    """
    oldest = filters.sort == "oldest"
    order = F.desc("doc_id") if oldest else F.asc("doc_id")
    docs = index.docs.filter(passes(Filters(since=filters.since, until=filters.until), ())).select("chunk", "doc_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform("categories", F.lower)))).alias("category"))
    heads = docs.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(order))).filter(F.col("k") <= limit).drop("k")
    ui = F.array(*[F.lit(c.lower()) for c in filters.categories]).cast("array<string>")
    wanted = F.array_distinct(F.concat("q.categories", ui))
    asked = queries.select("query_id", F.explode(F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("")))).alias("category"))
    found = asked.join(heads, "category").select("query_id", "chunk", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order)).cast("long")
    page = found.withColumn("rank", rank).filter(F.col("rank") <= limit)
    rows = index.docs.select("chunk", "doc_id", "id", "title", "published").join(page, ["chunk", "doc_id"])
    return rows.select("query_id", "rank", "doc_id", "id", "title", "published", F.lit(0.0).alias("score"), F.lit(0).alias("matched_fields"))


def read_log(queries: DataFrame) -> DataFrame:
    """(query_id, q): the parsed queries of a table (query_id, text)."""
    return stored(queries.select("query_id", parsed(F.col("text")).alias("q")), "log")


def has_positive() -> Column:
    return F.exists("q.terms", lambda t: ~t["negated"])


def search_log(index: Index, queries: DataFrame, filters: Filters = Filters(), limit: int = 25) -> DataFrame:
    """The first page of every query of a table (query_id, text): (query_id, rank, doc_id, id, title, published, score, matched_fields)."""
    log = read_log(queries)
    asked = log.filter(has_positive())
    scored = candidates(index, *asked_terms(index, asked, index.manifest.first()["doc_count"]))
    hits = resolved(index, scored, asked, filters)
    dates = {"newest": [F.desc("published")], "oldest": [F.asc("published")]}.get(filters.sort, [])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*dates, F.desc("score"), F.desc("raw_score"), "doc_id"))
    page = hits.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
    shown = index.docs.select("chunk", "doc_id", "id", "title").join(page, ["chunk", "doc_id"])
    ranked = shown.select("query_id", "rank", "doc_id", "id", "title", "published", F.round("score", 6).alias("score"), "matched_fields")
    return ranked.unionByName(browsed(index, log.filter(~has_positive()), filters, limit))


def log_totals(index: Index, queries: DataFrame, filters: Filters = Filters(), limit: int = 25) -> DataFrame:
    """(query_id, total, total_known, has_more) of every query with a positive term; ``total_known`` is false beyond the candidates."""
    log = read_log(queries).filter(has_positive())
    scored = stored(candidates(index, *asked_terms(index, log, index.manifest.first()["doc_count"])), "scored")
    counts = resolved(index, scored, log, filters).groupBy("query_id").agg(F.count("doc_id").alias("total"))
    sizes = scored.groupBy("query_id").agg(F.count("doc_id").alias("scored"))
    rows = log.select("query_id").join(counts, "query_id", "left").join(sizes, "query_id", "left")
    total = F.coalesce("total", F.lit(0)).cast("long")
    return rows.select("query_id", total.alias("total"), (F.coalesce("scored", F.lit(0)) <= CANDIDATES).alias("total_known"), (total > limit).alias("has_more"))


def notices(queries: DataFrame, cutoff: str, oldest: str) -> DataFrame:
    """(query_id, month): for each query of a table ``search.notice`` of an index whose abstracts begin at ``cutoff``, null for none."""
    reaches = F.exists("q.terms", lambda t: ~t["negated"] & ((t["fields"] == 0) | (t["fields"].bitwiseAND(F.lit(ABSTRACT)) != 0)))
    windowed = F.lit(bool(cutoff) and cutoff > oldest)
    return read_log(queries).select("query_id", F.when(windowed & reaches, cutoff[:7]).alias("month"))


# Related papers of all papers

#: Documents of a span, in whole zones; groups of seeds times spans, each a task, that a wave has at least; postings in a row of a span.
SPLIT, CELLS, PIECE = 1 << 16, 32, 1 << 18
#: Pairs of seeds and postings that a wave meets, in counting and in scoring: so many for each paper of the index, and so many at least.
PAIRS, PAIRS_LEAST = 32_768, 1_000_000_000
MARKS = "seed long, pairs long, numbers array<int>, weights array<double>"
SPANS = "span int, numbers binary, sizes binary, docs binary, weights binary"


def six_places(value: Column) -> Column:
    """Rounded as the SQL does it, by the product: ``F.round`` goes by decimal digits, and of values with nine places many lie halfway."""
    return F.round(value * 1e6) / 1e6


def useful_terms(index: Index) -> DataFrame:
    """(number, term, df, largest) of the terms that may mark a paper. They don't grow with the index: beyond 50,000 papers each is in a ten-thousandth of them."""
    n = index.manifest.first()["doc_count"]
    least = max(RELATED_FLOOR, int(n * RELATED_LEAST + 0.5))
    useful = index.terms.filter((F.length("term") >= RELATED_LENGTH) & (F.col("df") >= least) & (F.col("df") <= n * RELATED_MOST))
    return stored(numbered(useful, F.asc("term")), "useful")


def marks(index: Index, useful: DataFrame) -> DataFrame:
    """(seed, pairs, numbers, weights): up to 20 terms that mark each paper, by weight, as ``search.related_terms`` chooses them, and the sum of their df.

    A paper's terms lie in its row, so nothing is shuffled.
    """
    n = index.manifest.first()["doc_count"]
    known = useful.orderBy("number").select("term", "df").toArrow()
    names, df = known.column("term").combine_chunks(), known.column("df").to_numpy()
    rarity = np.maximum(0.05, np.log(1 + (n - df + 0.5) / (df + 0.5)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(batches, 32):
            table = pa.Table.from_batches(some)
            lists = {c: table.column(c).combine_chunks() for c in ("term", "tf", "at")}
            row = np.repeat(np.arange(len(table)), pc.list_value_length(lists["term"]).to_numpy())
            number = pc.fill_null(pc.index_in(lists["term"].flatten(), value_set=names), -1).to_numpy()
            tf, at = (lists[c].flatten().to_numpy() for c in ("tf", "at"))
            kept = np.flatnonzero((number >= 0) & (tf > 0))
            row, number, at = row[kept], number[kept], at[kept]
            weight = np.round((1 + np.log(tf[kept])) * rarity[number], 9)
            order = np.lexsort((at, -weight, row))
            row, number, weight = row[order], number[order], weight[order]
            start = np.searchsorted(row, np.arange(len(table) + 1))
            best = np.arange(len(row)) - start[row] < RELATED_TERMS
            row, number, weight = row[best], number[best], weight[best]
            ends = pa.array(np.searchsorted(row, np.arange(len(table) + 1)), pa.int32())
            pairs = np.bincount(row, df[number], len(table)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((number, pa.int32()), (weight, pa.float64()))]
            yield pa.record_batch([table.column("doc_id").combine_chunks(), pa.array(pairs), *lists], ["seed", "pairs", "numbers", "weights"])

    return index.counted.select("doc_id", *[F.col(f"terms.{c}").alias(c) for c in ("term", "tf", "at")]).mapInArrow(choose, MARKS)


def marked_terms(index: Index) -> DataFrame:
    """(seed, rank, term, term_weight, df, largest): the terms of ``marks``, a row each."""
    useful = useful_terms(index)
    each = marks(index, useful).select("seed", F.posexplode(F.arrays_zip("numbers", "weights")).alias("k", "t"))
    each = each.select("seed", (F.col("k") + 1).alias("rank"), F.col("t.numbers").cast("long").alias("number"), F.col("t.weights").alias("term_weight"))
    return each.join(F.broadcast(useful), "number").select("seed", "rank", "term", "term_weight", "df", "largest")


def spans_of(index: Index, useful: DataFrame) -> DataFrame:
    """(span, numbers, sizes, docs, weights): the useful terms' postings of each span of documents by term and document, in rows of about ``PIECE`` of them.

    A document's place in its span and its weight take three bytes where a span has up to 65,536 documents.
    """
    zones, width = span_size(index)
    place = place_type(width)

    def compact(key: tuple, table: pa.Table) -> pa.Table:
        number, first = (table.column(c).to_numpy() for c in ("number", "first"))
        order = np.lexsort((first, number))
        number, first, packed = number[order], first[order], table.column("packed").combine_chunks().take(pa.array(order))
        size, bits = pc.list_value_length(packed).to_numpy().astype(np.int64), packed.flatten().to_numpy()
        docs = (np.repeat(first - key[0].as_py() * width, size) + (bits >> (WEIGHT_BITS + MASK_BITS))).astype(place)
        weights = (bits & ((1 << WEIGHT_BITS) - 1)).astype(np.uint8)
        begins = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        number, size = number[begins].astype(np.int32), np.add.reduceat(size, begins)
        ends = np.cumsum(size)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(ends)]
        rows = []
        for low, high in zip(cuts, cuts[1:]):
            a, b = ends[low] - size[low], ends[high - 1]
            rows.append([x.tobytes() for x in (number[low:high], size[low:high], docs[a:b], weights[a:b])])
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*rows)]], ["span", "numbers", "sizes", "docs", "weights"])

    span = F.floor(F.col("zone") / zones).cast("int").alias("span")
    blocks = index.blocks.join(F.broadcast(useful.select("term", "number")), "term").select(span, "number", "first", "packed")
    return stored(blocks.groupBy("span").applyInArrow(compact, SPANS), "spans")


def span_size(index: Index) -> tuple[int, int]:
    """How many zones and documents a span has."""
    zones = max(1, SPLIT // index.config.docs_per_zone)
    return zones, zones * index.config.docs_per_zone


def place_type(width: int) -> type:
    return np.uint16 if width <= 1 << 16 else np.uint32


def shared_by(postings: pa.Table, seeds: pa.Table, span: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, documents, ranks, scores) of each seed: the span's documents that share its terms, in the order of the first shared term's rank, then by number."""
    kinds = {"numbers": np.int32, "sizes": np.int64, "docs": place_type(width), "weights": np.uint8}
    number, size, held, quantum = (np.concatenate([np.frombuffer(x, k) for x in postings.column(c).to_pylist()]) for c, k in kinds.items())
    begin = np.cumsum(size) - size
    of = np.full(int(number.max()) + 2, -1)
    of[number] = np.arange(len(number))
    lists = {c: seeds.column(c).combine_chunks() for c in ("numbers", "weights")}
    ends = np.append(0, np.cumsum(pc.list_value_length(lists["numbers"]).to_numpy()))
    asked = of[np.minimum(lists["numbers"].flatten().to_numpy(), len(of) - 1)]
    begin, size = np.append(begin, 0)[asked], np.append(size, 0)[asked]
    factor = lists["weights"].flatten().to_numpy()
    steps = weight_of(np.arange(1 << WEIGHT_BITS, dtype=np.float64))
    total, place, most = np.zeros(width), np.zeros(width, np.int64), np.arange(1)
    for k, seed in enumerate((seeds.column("seed").to_numpy() - span * width).tolist()):
        low, high = ends[k], ends[k + 1]
        sizes = size[low:high]
        until = np.cumsum(sizes)
        n = int(until[-1]) if len(until) else 0
        if n > len(most):
            most = np.arange(2 * n)
        at = np.repeat(begin[low:high] - until + sizes, sizes) + most[:n]
        docs = held[at].astype(np.int64)
        np.add.at(total, docs, np.repeat(factor[low:high], sizes) * steps[quantum[at]])
        place[docs[::-1]] = most[:n][::-1]
        new = np.flatnonzero(place[docs] == most[:n])
        found = docs[new]
        scores = total[found]
        total[found] = 0.0
        others = found != seed
        if not others.all():
            found, new, scores = found[others], new[others], scores[others]
        yield k, found + span * width, np.searchsorted(until, new, "right"), scores


def first_counts(postings: pa.Table, seeds: pa.Table, span: int, width: int) -> pa.Table:
    """(seed, span, counts): how many of a span's documents have which rank as that of the first term they share with a seed."""
    counts = np.zeros((len(seeds), RELATED_TERMS), np.int32)
    for k, _, ranks, _ in shared_by(postings, seeds, span, width) if len(seeds) and len(postings) else ():
        counts[k] = np.bincount(ranks, minlength=RELATED_TERMS)
    ends = pa.array(np.arange(len(seeds) + 1) * RELATED_TERMS, pa.int32())
    return pa.table([seeds.column("seed"), pa.array([span] * len(seeds), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], ["seed", "span", "counts"])


def competing(counts: np.ndarray, most: int) -> np.ndarray:
    """How many documents of each span are among the first ``most`` by rank, then by number, from counts by seed, span and rank."""
    total = counts.sum(1)
    until = total.cumsum(1)
    last = np.minimum((until < most).sum(1), RELATED_TERMS - 1)  # the rank at which the candidates end
    seeds = np.arange(len(counts))
    at = counts[seeds, :, last]
    left = (most - until[seeds, last] + total[seeds, last])[:, None] - (at.cumsum(1) - at)
    return np.where(np.arange(RELATED_TERMS) < last[:, None, None], counts, 0).sum(2) + np.clip(left, 0, at)


def span_best(postings: pa.Table, seeds: pa.Table, span: int, width: int, limit: int) -> pa.Table:
    """(seed, doc_id, first, score) of the best of a span's documents that compete."""
    places, parts = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    some = len(seeds) and len(postings)
    admitted = pc.fill_null(seeds.column("admitted"), width).to_pylist() if some else []
    for k, docs, ranks, scores in shared_by(postings, seeds, span, width) if some else ():
        docs, scores = docs[: admitted[k]], scores[: admitted[k]]
        if len(docs) > limit:
            # Scores are rounded: what may round to the last one stays. The others are in the order that decides ties.
            high = np.flatnonzero(scores >= np.partition(scores, len(docs) - limit)[len(docs) - limit] - 1e-8)
        else:
            high = np.arange(len(docs))
        scores = np.round(scores[high], 9)
        best = np.argsort(-scores, kind="stable")[:limit]
        places.append(np.full(len(best), k))
        parts.append((docs[high[best]], ranks[high[best]], scores[best]))
    docs, ranks, scores = (np.concatenate([p[k] for p in parts]) for k in range(3))
    ids = seeds.column("seed").take(pa.array(np.concatenate(places)))
    return pa.table([ids, pa.array(docs, pa.int64()), pa.array(ranks, pa.int32()), pa.array(scores)], ["seed", "doc_id", "first", "score"])


def related_all(index: Index, limit: int = 6, most: int = CANDIDATES, first: int = RELATED_TERMS) -> DataFrame:
    """(seed, rank, doc_id, id, title, score): for every paper what ``search.related`` gives for it alone.

    Groups of seeds meet the postings of their terms a span of documents at a time, in Arrow: the documents that share a term with
    a seed are made and scored within a task, and only the span's best leave it. Of seeds that can have more than ``most`` candidates,
    these are first counted by span and rank, which tells how many of a span compete. All of a seed's terms are met at once, whatever ``first`` is.

    Seeds are taken in waves, so that the tables and shuffle files of a wave, which go with it, are bounded.
    """
    spark, useful, (_, width) = index.papers.sparkSession, useful_terms(index), span_size(index)
    seeds, spans = stored(marks(index, useful), "marks"), spans_of(index, useful)
    last = spans.agg(F.max("span")).first()[0] or 0
    groups = -(-CELLS // (last + 1))
    spread = spans.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("group", "span")

    def meet(asked: DataFrame, f, kinds: str) -> DataFrame:
        group = F.pmod(F.xxhash64("seed"), F.lit(groups)).cast("int").alias("group")
        return spread.cogroup(asked.withColumn("group", group).groupBy("group", "span")).applyInArrow(f, kinds)

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("counts").flatten().field("counts").flatten().to_numpy().reshape(len(batch), -1, RELATED_TERMS)
            ends = pa.array(np.arange(len(batch) + 1) * counts.shape[1], pa.int32())
            yield pa.record_batch([batch.column("seed"), pa.ListArray.from_arrays(ends, pa.array(competing(counts, most).ravel(), pa.int64()))], ["seed", "admitted"])

    path = f"{shared_dir(spark)}/related-{uuid.uuid4().hex}"
    work = F.sum(F.when(F.col("pairs") > most, 2 * F.col("pairs")).otherwise(F.col("pairs")))
    count = max(1, math.ceil((seeds.agg(work).first()[0] or 0) / max(PAIRS * index.manifest.first()["doc_count"], PAIRS_LEAST)))
    for wave in range(count):
        mine = seeds.filter(F.pmod(F.xxhash64(F.lit(count), "seed"), F.lit(count)) == wave)
        every = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("span")
        large = mine.filter(F.col("pairs") > most).select("seed", "numbers", "weights", every)
        counted = stored(meet(large, lambda key, p, s: first_counts(p, s, key[1].as_py(), width), "seed long, span int, counts array<int>"), "counts")
        gathered = counted.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("span", "counts"))).alias("counts"))
        admitted = gathered.mapInArrow(admit, "seed long, admitted array<long>")
        asked = mine.join(admitted, "seed", "left").select("seed", "numbers", "weights", "admitted", every).withColumn("admitted", F.get("admitted", F.col("span")))
        pairs = stored(meet(asked, lambda key, p, s: span_best(p, s, key[1].as_py(), width, limit), "seed long, doc_id long, first int, score double"), "pairs")
        discard(counted)
        order = [F.desc("score"), F.asc("first"), F.asc("doc_id")]
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
        with shuffles_removed(spark):
            best.select("seed", "rank", "doc_id", "score").write.mode("append").parquet(path)
        discard(pairs)
    discard(spans)
    best = spark.read.schema("seed long, rank long, doc_id long, score double").parquet(path)
    shown = index.docs.select("chunk", "doc_id", "id", "title").join(at_chunks(index, best), ["chunk", "doc_id"])
    return shown.select("seed", "rank", "doc_id", "id", "title", six_places(F.col("score")).alias("score"))
