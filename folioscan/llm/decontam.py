"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

``postings`` stores (term, doc_id, pos) of the training documents. A window of a benchmark item is
looked up from its rarest terms, by their counts over the whole corpus: the postings of a window's two
rarest terms, each moved back by the term's offset in the item, must meet in one alignment of a
document and an item. Alignments that hold both are confirmed word by word against the document. Where
the words stand at their offsets they give the exact runs, hence all windows that occur; a window is *near*
if there is an alignment from which each of its words stands at most ``slop`` words off its offset, as when
words were put in between or swapped. Every exact match is a near one.

Words are runs of characters outside ``\\x00-\\x2F``, ``\\x3A-\\x60`` and ``\\x7B-\\x7F`` after A-Z are
lower-cased. A window is ``width`` consecutive words; an item of fewer, but some, words is one window.

Only documents with an alignment are shuffled, to meet their list (see ``joins``); the others' words are
counted in place.

Defined results: null texts have no words; items without words, or without an id, are left out;
repeated items of one id count once, and different texts of one id are alternatives of it; a row
without doc_id is matched as the others are, rows of one doc_id each by their own words; of the
documents only the named columns are read. A term list is broadcast only when counted to be at most
``BROADCAST`` rows; beyond that Spark joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, stored
from .joins import lookup

BROADCAST = 200_000
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order. ``lower`` is as good as A-Z alone where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def bounded(df: DataFrame, size: Column | None = None) -> DataFrame:
    """A broadcast hint, if the frame's rows, or their summed ``size``, are counted to be few enough."""
    total = df.agg(F.count(F.lit(1)) if size is None else F.sum(size)).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST else df


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(rid, item, w): distinct items with words; ``rid`` numbers an item's text."""
    rows = benchmark.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).filter((F.size("w") > 0) & F.col("item").isNotNull()).distinct()
    return cut(rows.select(F.xxhash64("item", "w").alias("rid"), "item", "w"))


def postings(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index (term, doc_id, pos); of the given distinct terms only, if any are."""
    each = docs.select(F.col(key).alias("doc_id"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return (each if terms is None else each.join(bounded(terms), "term")).select("term", "doc_id", "pos")


def rarest(docs: DataFrame, items: DataFrame, width: int, text: str = "text") -> DataFrame:
    """(rid, start, first, second): for each window that can occur, the item offsets of its two rarest terms."""
    placed = items.select("rid", F.size("w").alias("n"), F.posexplode("w").alias("at", "term"))
    vocabulary = cut(placed.select("term").distinct())
    counts = docs.select(F.explode(words(F.col(text))).alias("term")).join(bounded(vocabulary), "term").groupBy("term").agg(F.count("term").alias("df"))
    known = placed.join(bounded(cut(counts)), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least("at", F.greatest(F.lit(0), F.col("n") - width)))
    each = known.select("rid", "at", "term", "df", F.explode(starts).alias("start"))
    # Of one term's occurrences in a window only the first counts, so that the second list is another term's.
    once = each.groupBy("rid", "start", "term").agg(F.min("at").alias("at"), F.min("df").alias("df"))
    ranked = once.groupBy("rid", "start").agg(F.array_sort(F.collect_list(F.struct("df", "at"))).alias("r"))
    ranked = ranked.filter(F.get("r", F.lit(0))["df"] > 0)
    return ranked.select("rid", "start", F.get("r", F.lit(0))["at"].alias("first"), F.coalesce(F.get("r", F.lit(1))["at"], F.get("r", F.lit(0))["at"]).alias("second"))


def alignments(docs: DataFrame, items: DataFrame, width: int, slop: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid, delta, exact): where the lists of some window's rarest terms meet within ``slop``.

    ``delta`` is the item's place in the document, ``exact`` whether both stand at their offsets.
    """
    windows = cut(rarest(docs, items, width, text))
    needed = windows.select("rid", F.explode(F.array("first", "second")).alias("at")).distinct()
    offsets = cut(needed.join(items, "rid").select("rid", "at", F.get("w", F.col("at")).alias("term")))
    index = stored(postings(docs, cut(offsets.select("term").distinct()), key, text), "postings")
    off = F.explode(F.array(*[F.lit(d) for d in range(-slop, slop + 1)])).alias("off")
    lists = index.join(bounded(offsets), "term").select("doc_id", "rid", "at", (F.col("pos") - F.col("at")).alias("delta"))
    lists = lists.select("doc_id", "rid", "at", "delta", off).withColumn("delta", F.col("delta") + F.col("off"))
    met = lists.groupBy("doc_id", "rid", "delta").agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("off") == 0, F.col("at"))).alias("own"))
    pairs = bounded(cut(windows.groupBy("rid").agg(F.collect_set(F.struct("first", "second")).alias("pairs"))), F.size("pairs"))
    whole = lambda ats: F.exists("pairs", lambda x: F.array_contains(ats, x["first"]) & F.array_contains(ats, x["second"]))
    return met.join(pairs, "rid").filter(whole("ats")).select("doc_id", "rid", "delta", whole("own").alias("exact"))


def runs(item: Column, delta: Column, w: Column, width: int, slop: int = 0) -> Column:
    """The maximal runs [a, b) of an item's offsets, of a window at least, that match a document's words ``w`` from ``delta`` on."""
    start = F.struct(F.lit(0).alias("since"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out"))

    def stands(i: Column) -> Column:
        one = F.lit(False)
        for d in range(-slop, slop + 1):
            one |= F.coalesce(F.get(w, delta + i + d) == F.get(item, i), F.lit(False))
        return (i < F.size(item)) & one

    def step(acc: Column, i: Column) -> Column:
        run = F.array(F.struct(acc["since"].alias("a"), i.alias("b")))
        out = F.when(i - acc["since"] >= F.least(F.lit(width), F.size(item)), F.concat(acc["out"], run)).otherwise(acc["out"])
        return F.when(stands(i), acc).otherwise(F.struct((i + 1).alias("since"), out.alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(item)), start, step, lambda acc: acc["out"])


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 1, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (doc_id, n_words, phrases, hits, near), with ``extra`` columns of ``docs``.

    ``phrases`` holds (item, a, b) for each run of words [a, b) that matches an item over a window or
    more; ``hits`` the disjoint word ranges that they cover; ``near`` the items with a near window.
    """
    items = items_of(benchmark, item, item_text)
    found = alignments(docs, items, width, slop, key, text)
    found = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("delta", "exact")).alias("at")).join(bounded(items, F.size("w")), "rid")
    by_doc = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("item", "w", "at")).alias("_c")), "alignments")
    # Texts are joined, not their words, which would be larger.
    plain, others = lookup(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_x"), *[F.col(x) for x in extra]), ["doc_id"], by_doc)
    none = F.expr("cast(array() as array<struct<item:string,a:int,b:int>>)")
    plain = plain.select("doc_id", *extra, F.size(words(F.col("_x"))).cast("long").alias("n_words"), none.alias("phrases"), F.expr("cast(array() as array<string>)").alias("near"))

    def of_item(c: Column, w: Column) -> Column:
        exact = F.filter(c["at"], lambda d: d["exact"])
        place = lambda d: F.transform(runs(c["w"], d["delta"], w, width), lambda r: F.struct(c["item"].alias("item"), (d["delta"] + r["a"]).alias("a"), (d["delta"] + r["b"]).alias("b")))
        return F.flatten(F.transform(exact, place))

    def found_in(w: Column) -> Column:
        close = F.filter("_c", lambda c: F.exists(c["at"], lambda d: F.size(runs(c["w"], d["delta"], w, width, slop)) > 0))
        near = F.array_sort(F.array_distinct(F.transform(close, lambda c: c["item"])))
        phrases = let(F.array_sort(F.flatten(F.transform("_c", lambda c: of_item(c, w)))), unlike)
        return F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(phrases, none).alias("phrases"), F.coalesce(near, F.expr("cast(array() as array<string>)")).alias("near"))

    # The words are bound, as a column that only a lambda uses would be made anew at each of its steps.
    others = others.select("doc_id", *extra, let(words(F.col("_x")), found_in).alias("_m")).select("doc_id", *extra, "_m.n_words", "_m.phrases", "_m.near")
    rows = plain.unionByName(others)
    return rows.withColumn("hits", covered(F.col("phrases")))


def unlike(values: Column) -> Column:
    """Sorted values without repeats: ``array_distinct`` compares structs pair by pair."""
    return F.filter(values, lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(values, k - 1)))


def covered(ranges: Column) -> Column:
    """The disjoint ranges [a, b) that ranges cover, in order; those that touch are one.

    With starts and ends sorted apart, the ranges before place k have all ended where the k-th smallest end lies
    before the start at k: that is where a gap is.
    """
    a, b = F.array_sort(F.transform(ranges, lambda r: r["a"])), F.array_sort(F.transform(ranges, lambda r: r["b"]))

    def joined(v: Column) -> Column:
        n = F.size(v["a"]) - 1
        gaps = F.filter(F.arrays_zip(F.slice(v["b"], 1, n).alias("b"), F.slice(v["a"], 2, n).alias("a")), lambda g: g["b"] < g["a"])
        starts = F.concat(F.slice(v["a"], 1, 1), F.transform(gaps, lambda g: g["a"]))
        ends = F.concat(F.transform(gaps, lambda g: g["b"]), F.slice(v["b"], -1, 1))
        return F.arrays_zip(starts.alias("a"), ends.alias("b"))

    out = let(F.struct(a.alias("a"), b.alias("b")), joined)
    return F.when(F.size(ranges) > 0, out).otherwise(F.expr("cast(array() as array<struct<a:int,b:int>>)"))


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"]))
