"""Spelling variants: pairs of words at edit distance one, and the frequent form that each rare word stands for.

The pairs come from self-joins of tries with active-node sets: the active nodes of a trie node are those whose
string is one edit away from its own; a child's follow from its parent's, so going down the trie carries them along,
and a terminal node's active terminal nodes are its near words.

The vocabulary is dealt to tries by what one edit leaves alone. Of two words, the shorter of length L, the edit
lies in the first half of the places, and both share what follows it, or in the second, and both share what
precedes it. A trie holds the words of one class (lengths L and L + 1), one interval of places, and one shared
prefix and suffix; a word goes to four. A trie of more than ``MOST`` words is dealt again by the halves of its
interval. At an interval of one place the words differ in that place alone, so the alphabet bounds their number.
Each pair is taken from the one trie whose interval has the pair's place, the end of the common prefix: none is
found twice, none is lost, whatever the words' distribution.

A word's form is its near word of the largest count, the smallest in code-point order of several, if that count is
at least ``ratio`` times the word's own. Counts grow by that ratio along forms, so a chain of forms has no cycle
and at most log(largest count) / log(ratio) steps; doubling the steps finds its end in a few joins.

Defined results: null and empty texts have no words; a null key is written as the empty string where a run is
hashed; repeated rows count again; no rows, or no frequent word, give no rows. Texts of any length are read once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins
from .common import released, stored

#: Words of a trie that is not dealt again, and distinct words that a task counts before it sends them on.
MOST, HELD = 4096, 200_000
KEY = ["length", "low", "high", "prefix", "suffix"]


@dataclass(frozen=True)
class Params:
    """``letters``: the class of a run's characters, once A-Z are lower case; ``drop``: of runs whose hash it divides, a code point goes."""

    letters: str = "[a-zÀ-ÿ]"
    length: int = 6
    count: int = 5
    ratio: int = 5
    drop: int | None = None


def typed(run: str, hashed: int, drop: int) -> str:
    """The run, or what is left of it where ``drop`` divides its hash."""
    if hashed % drop:
        return run
    at = hashed % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of ``p.length`` code points or more that occur ``p.count`` times or more."""
    # A shorter run is no word, whatever goes of it; a longer one is found whole.
    pattern, length, drop = f"{p.letters}{{{p.length},}}", p.length, p.drop

    def sent(total: Counter) -> pa.RecordBatch:
        rows = [(w, n) for w, n in total.items() if len(w) >= length]
        total.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = re.compile(pattern).findall, Counter()
        with released():
            for batch in batches:
                for k, x in zip(batch.column(0), batch.column(1)):
                    if not x.is_valid:
                        continue
                    runs = find(x.as_buffer().to_pybytes().lower().decode())
                    if drop:
                        start = zlib.crc32(f"{k.as_py()}:".encode())
                        fixed = {}
                        for w in set(runs):
                            h = zlib.crc32(w.encode(), start)
                            if not h % drop:
                                fixed[w] = typed(w, h, drop)
                        if fixed:
                            runs = [fixed.get(w, w) for w in runs]
                    total.update(runs)
                    if len(total) > HELD:
                        yield sent(total)
            yield sent(total)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= p.count)


def placed(rows: DataFrame) -> DataFrame:
    """Add what words of a class and an interval must share: ``prefix`` and ``suffix``."""
    after = F.col("length") - 1 - F.col("high")
    return rows.withColumn("prefix", F.expr("substring(word, 1, low)")).withColumn("suffix", F.when(after > 0, F.expr("right(word, length - 1 - high)")).otherwise(""))


def dealt(words: DataFrame, most: int = MOST) -> list[DataFrame]:
    """(word, n) by trie; the frames together have every word in every trie it belongs to."""
    own = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("length")).filter("length > 0")
    half = (F.col("length") / 2).cast("int")
    both = F.filter(F.array(F.struct(F.lit(0).alias("low"), (half - 1).alias("high")), F.struct(half.alias("low"), (F.col("length") - 1).alias("high"))), lambda s: s["low"] <= s["high"])
    rows = placed(rows.select("word", "n", "length", F.explode(both).alias("s")).select("word", "n", "length", "s.low", "s.high"))
    out = []
    while True:
        large = stored(rows.groupBy(*KEY).agg(F.count("word").alias("c")).filter(f"c > {most} and low < high").select(*KEY), "large")
        if large.isEmpty():
            return [*out, rows]
        rows = stored(rows, "dealt")
        out.append(joins.without(rows, KEY, large))
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
        rows = placed(joins.only(rows, KEY, large).select("word", "n", "length", F.explode(halves).alias("s")).select("word", "n", "length", "s.low", "s.high"))


class Trie:
    """Nodes by number, the root 0: their children, and the word that ends there or -1."""

    def __init__(self, words: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word = [-1]
        for k, w in enumerate(words):
            at = 0
            for ch in w:
                to = self.children[at].get(ch)
                if to is None:
                    to = self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                at = to
            self.word[at] = k

    def near(self) -> Iterator[tuple[int, int]]:
        """(a, b) of all words at distance one, both ways around.

        One edit from a child: its parent (deleted), its siblings (replaced), its children (inserted), and the
        children by its own character of the nodes that are one edit from its parent.
        """
        stack = [(0, set(self.children[0].values()))]
        while stack:
            node, active = stack.pop()
            if self.word[node] >= 0:
                for m in active:
                    if self.word[m] >= 0:
                        yield self.word[node], self.word[m]
            below = self.children[node]
            for ch, child in below.items():
                reached = {node, *below.values(), *self.children[child].values()}
                reached.discard(child)
                for m in active:
                    to = self.children[m].get(ch)
                    if to is not None:
                        reached.add(to)
                stack.append((child, reached))


def common(a: str, b: str) -> int:
    """The length of the common prefix."""
    for k, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return k
    return min(len(a), len(b))


def joined(rows: list[tuple], length: int, low: int, high: int) -> Iterator[tuple]:
    """(word, n, near, near_n), both ways around, of one trie's pairs whose place is in its interval."""
    after = length - 1 - high
    for a, b in Trie([w[low : len(w) - after] for w, _ in rows]).near():
        (u, n), (v, m) = rows[a], rows[b]
        if min(len(u), len(v)) == length and low <= min(common(u, v), length - 1) <= high:
            yield u, n, v, m


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): every pair of distinct words at distance one, a row for either side."""

    def sent(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * 4
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "near", "near_n"])
        found.clear()
        return out

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, found = None, [], []
        for batch in batches:
            for word, n, *key in zip(*[batch.column(c).to_pylist() for c in ("word", "n", *KEY)]):
                if key != last:
                    if len(rows) > 1:
                        found.extend(joined(rows, *last[:3]))
                    last, rows = key, []
                    if len(found) > HELD:
                        yield sent(found)
                rows.append((word, n))
        if len(rows) > 1:
            found.extend(joined(rows, *last[:3]))
        yield sent(found)

    out = None
    for part in dealt(words, most):
        # Tries are built one after the other from sorted rows; a hash deals them.
        tries = part.select("word", "n", *KEY).repartition(*KEY).sortWithinPartitions(*KEY)
        pairs = tries.mapInArrow(join, "word string, n long, near string, near_n long")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def followed(links: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of (word, form), by steps that double until none moves."""
    steps = stored(links.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = stored(steps.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "steps")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the vocabulary, its form or null, and the end of its forms."""
    words = stored(vocabulary(docs, p, key, text), "words")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.first("n").alias("own"), F.count("near").alias("n_near"), best.alias("best"))
    formed = F.col("best.near_n") >= p.ratio * F.col("own")
    near = stored(near.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("best.near_n")).alias("form_n")), "near")
    roots = followed(near.filter(F.col("form").isNotNull()))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
