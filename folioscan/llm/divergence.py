"""Divergence of sources: how far the word frequencies of each group lie from those of its language's other groups.

A group is a source in a language. Frequencies are integers, ``share``: 1 + floor(1e9 * (n + 2) / (N + 2 V)) of a count n in a
group of N counted terms, V being the terms that the language keeps; two of them differ by floor((p - q)^2 / (p + q)).
The sums of two groups over all kept terms are made of three parts, in integers throughout:

* what two absent terms differ by, for each of the V terms;
* heavy terms, in more than ``rare`` groups: a dense tile of terms by groups in numpy, less the first part;
* rare terms, in few groups: their postings alone. A posting corrects the sum with every group as though the term were
  absent there, equal counts of a group at once; each pair of postings of a term then corrects its own pair.

A tile has the groups of two blocks of about ``BLOCK`` sources and a chunk of about ``CHUNK`` terms, and is a task's whole
unit: neither a frequent term nor a large source is in one place. Tiles' sums are added by a grouped sum.

Defined results: a null text, language or source is the empty string; repeated rows count as documents of their own; a
language that keeps no term has pairs of value 0 and no terms; no rows give no rows. Counts up to 9e15 are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, stored

SCALE, ADDED = 1_000_000_000, 2
#: Distinct terms that a task counts before it sends them on; sources of a block and terms of a chunk, about.
HELD, BLOCK, CHUNK = 300_000, 192, 4096
#: What ends a term, of ASCII; letters A-Z become small, other bytes stay.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
TILE = "lang string, one string, other string, value long"


@dataclass(frozen=True)
class Params:
    """A term is kept by ``docs`` documents of a language; ``top``: terms that are listed of a group; ``rare``: most groups of a rare term."""

    docs: int = 10
    top: int = 10
    rare: int = 4


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents with it."""
    schema = "lang string, source string, term string, n long, docs long"

    def sent(counts: dict) -> Iterator[pa.RecordBatch]:
        for (one, group), (n, d) in counts.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.array([one] * len(n), pa.string()), pa.array([group] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = {}, 0
        with released():
            for batch in batches:
                for one, group, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    terms = x.as_buffer().to_pybytes().translate(LETTERS).split()
                    n, d = counts.setdefault((one, group), (Counter(), Counter()))
                    held -= len(n)
                    n.update(terms)
                    d.update(set(terms))
                    held += len(n)
                    if held > HELD:
                        yield from sent(counts)
                        held = 0
            yield from sent(counts)

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, p: Params) -> DataFrame:
    """(lang, term, n, postings): terms that their language keeps, with what each group has of them."""
    each = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return each.filter(F.col("docs") >= p.docs).drop("docs")


def facts(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, terms, lang_total, sources): a row for every group."""
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("source").alias("sources"))
    rows = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("lang", "source", zero("total"), zero("terms"), zero("lang_total"), "sources")


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + ADDED) / total), three digits of base 1000 at a time, so that no product overflows."""
    rest, out = n + ADDED, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


def share_sql(n: str, total: str) -> str:
    """``share`` as an SQL expression of two expressions of positive longs."""
    first = f"({n} + {ADDED}) * 1000L"
    second = f"({first} % ({total})) * 1000L"
    third = f"({second} % ({total})) * 1000L"
    return f"1 + ({first} div ({total})) * 1000000L + ({second} div ({total})) * 1000L + {third} div ({total})"


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tile(terms: pa.Table, groups: pa.Table, rare: int) -> pa.Table:
    """Partial sums of the pairs of a tile's groups: of the first block with the second, or within the one."""
    rows = groups.to_pydict()
    names, total = rows["source"], np.array(rows["total"], np.int64) + ADDED * np.array(rows["terms"], np.int64)
    n, V = len(names), rows["terms"][0]
    value = np.zeros((n, n), np.int64)
    if V:
        absent = share(np.zeros(n, np.int64), total)
        plain = apart(absent[:, None], absent[None, :])
        if not rows["chunk"][0]:
            value += V * plain
        postings = terms["postings"].combine_chunks()
        size = pc.list_value_length(postings).to_numpy()
        flat = postings.flatten()
        at = pc.index_in(flat.field("source"), pa.array(names, pa.string())).to_numpy()
        part = share(flat.field("n").to_numpy(), total[at])
        of = np.repeat(np.arange(len(size)), size)
        heavy = terms["heavy"].to_numpy()
        # Heavy terms: dense.
        row, dense = np.cumsum(heavy) - 1, np.repeat(absent[None, :], int(heavy.sum()), 0)
        chosen = heavy[of]
        dense[row[of[chosen]], at[chosen]] = part[chosen]
        for a in range(n):
            value[a] += (apart(dense, dense[:, a : a + 1]) - plain[a]).sum(0)
        # Rare terms: every posting against the groups without the term, then pairs of postings.
        for a in range(n):
            own, times = np.unique(part[~chosen & (at == a)], return_counts=True)
            one_sided = (times[:, None] * (apart(own[:, None], absent[None, :]) - plain[a])).sum(0)
            value[a] += one_sided
            value[:, a] += one_sided
        first = np.cumsum(size) - size
        for m in range(2, rare + 1):
            start = first[~heavy & (size == m)]
            for i, j in combinations(range(m), 2):
                a, b, p, q = at[start + i], at[start + j], part[start + i], part[start + j]
                fix = apart(p, q) - apart(p, absent[b]) - apart(absent[a], q) + plain[a, b]
                np.add.at(value, (a, b), fix)
                np.add.at(value, (b, a), fix)
    block, (one, other) = np.array(rows["block"]), (rows["one"][0], rows["other"][0])
    a, b = np.nonzero(np.triu(np.ones((n, n), bool), 1) if one == other else (block[:, None] == one) & (block[None, :] == other))
    named = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([rows["lang"][0]] * len(a), pa.string()), "one": named.take(a), "other": named.take(b), "value": value[a, b]})


def pair_sums(kept: DataFrame, groups: DataFrame, p: Params) -> DataFrame:
    """(lang, source, item, value): what each two groups of a language differ by, a row for either side."""
    blocks = lambda: F.ceil(F.col("sources") / BLOCK).cast("int")
    chunks = lambda: F.ceil(F.greatest("terms", F.lit(1)) / CHUNK).cast("int")
    block_of = lambda source, of: F.pmod(F.xxhash64(source), of).cast("int")
    langs = groups.groupBy("lang").agg(F.first("sources").alias("sources"), F.first("terms").alias("terms"))
    langs = stored(langs.select("lang", blocks().alias("blocks"), chunks().alias("chunks")), "langs")
    key = ["lang", "one", "other", "chunk"]
    pairs = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("one"), j.alias("other")))))

    placed = kept.join(langs, "lang").withColumn("heavy", F.size("postings") > p.rare).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks").cast("int"))
    # Which pairs of blocks a term has to do with, and its postings there.
    spread = placed.withColumn("t", F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("other")))).otherwise(pairs(F.col("blocks")))))
    inside = lambda x: block_of(x["source"], F.col("blocks")).isin(F.col("t.one"), F.col("t.other"))
    terms = spread.select("lang", "t.one", "t.other", "chunk", "heavy", F.when(F.col("blocks") == 1, F.col("postings")).otherwise(F.filter("postings", inside)).alias("postings")).filter(F.size("postings") > 0)

    told = groups.join(langs, "lang").withColumn("block", block_of(F.col("source"), F.col("blocks")))
    told = told.withColumn("t", F.explode(F.filter(pairs(F.col("blocks")), lambda t: (t["one"] == F.col("block")) | (t["other"] == F.col("block")))))
    frames = told.select("lang", "t.one", "t.other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "source", "total", "terms", "block")

    rare = p.rare
    sums = terms.groupBy(*key).cogroup(frames.groupBy(*key)).applyInArrow(lambda left, right: tile(left, right, rare), TILE)
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))
    return sums.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value")


def marking_terms(kept: DataFrame, groups: DataFrame, p: Params) -> DataFrame:
    """(lang, source, item, value): terms that a group has more of than its language, by what they differ by."""
    each = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.explode("postings").alias("x")).select("lang", "item", "lang_n", "x.source", "x.n")
    met = each.join(groups, ["lang", "source"])
    met = met.withColumn("p", F.expr(share_sql("n", f"total + {ADDED} * terms"))).withColumn("q", F.expr(share_sql("lang_n", f"lang_total + {ADDED} * terms")))
    return met.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(docs: DataFrame, p: Params = Params(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group, ``pair`` rows of all other sources and ``term`` rows of its ``top`` terms."""
    kept = stored(kept_terms(term_counts(docs, lang, source, text), p), "kept")
    groups = stored(facts(docs, kept, lang, source), "groups")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_sums(kept, groups, p).withColumn("rank", rank)
    terms = marking_terms(kept, groups, p).withColumn("rank", rank).filter(F.col("rank") <= p.top)
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))
