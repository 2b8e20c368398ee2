"""MinHash near-duplicates by a multi-index Hamming join.

A text is the set of its distinct shingles of words. Equal sets are one class first. A class gets a
b-bit signature: ``chunks * width`` minima of hashed shingles, ``bits`` bits of each. Two signatures
that differ in fewer than ``chunks * (errors + 1)`` symbols have, by the pigeonhole principle, a
chunk that differs in at most ``errors`` symbols; with the chunk's keys enumerated under every
choice of ``errors`` left-out symbols, such a pair shares a key. So the index of keys finds all pairs
under that distance (23 of 84 symbols with the defaults, as one error is allowed in each of 12
chunks), and no pair list of a whole bucket is needed to use it:

1. classes that share a key with another are the members; a member's *own* shingles are those that no
   other member has, so two members share at most ``min(n1 - own1, n2 - own2)`` shingles, which rules
   out most pairs without a comparison;
2. each member is compared with the hub of its buckets, the member with the fewest own shingles, and
   components are formed; then with other hubs, where components still differ;
3. in buckets that still hold several components, members of different components are compared, as
   far as the bound allows a link.

Every link is confirmed on the full shingle sets. A class that would link two members of one
component needs no further comparison, so groups of thousands of copies cost links, not pairs.

What a bucket's members cost: they are dealt to at most ``grid`` blocks, and a row goes to a task for each
pair of its block with another, so shuffled rows are at most ``grid`` times the members. Comparisons of
members that stay in different components are as many as their pairs, on bitmaps within those tasks.

Defined results: texts without words, and null texts, have no shingle and link with nothing; fewer
words than a shingle are one shingle; a row without id gets its size, no component and ``kept``. Rows of
one id are one document: its links are those of its row whose set has the smallest digest (rows without
words aside), other texts of the id link with nothing, and every row gets the size of its own set and the
id's component. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, cut, mix32, mix64, released, slices, stored, trim
from .graph import components
from .joins import by_class, lookup, only


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    percent: int = 75
    chunks: int = 12
    width: int = 7
    errors: int = 1
    bits: int = 16
    cells: int = 1024
    block: int = 1024
    grid: int = 32
    seed: int = 11

    @property
    def symbols(self) -> int:
        return self.chunks * self.width


class Words(Hashed):
    """A Hashed of words that are bytes already."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, n: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``n`` words.

    Only A-Z is lower-cased and only ASCII white space parts words: as ``bytes`` methods do.
    """
    h = words.of(text.encode("utf-8", "surrogatepass").lower().split()) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    length = min(n, len(h))
    every = np.full(len(h) - length + 1, length, np.uint64)
    for k in range(length):
        every = mix64(every + h[k : len(h) - length + 1 + k]) if k < length - 1 else every * np.uint64(31) + h[k : len(h) - length + 1 + k]
    return np.unique(mix64(every))


def signature(found: np.ndarray, p: Params) -> np.ndarray:
    """``p.symbols`` b-bit symbols of the minima of the set's hashes."""
    rng = np.random.default_rng(p.seed)
    salt = rng.integers(0, 1 << 32, (2, p.symbols, 1), np.uint32)
    odd = salt[1] | np.uint32(1)
    least = np.full(p.symbols, 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        least = np.minimum(least, ((x[at : at + 1024] ^ salt[0]) * odd).min(axis=1))
    return (mix32(least) >> np.uint32(32 - p.bits)).astype(np.uint16)


def keys(signatures: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each row of symbols: each chunk under each choice of left-out symbols.

    Also, for each key, the left-out symbol plus one, or 0. Two rows that share a key and this word
    agree in the whole chunk, and so share its first key, whose word is 0: that one is enough.
    """
    out, left_out = [], []
    for c in range(p.chunks):
        chunk = signatures[:, c * p.width : (c + 1) * p.width].astype(np.uint64)
        for number, left in enumerate(combinations(range(p.width), p.errors)):
            h = np.full(len(chunk), c << 32 | number, np.uint64)
            for k in range(p.width):
                if k not in left:
                    h = mix64(h + chunk[:, k] + np.uint64(1))
            out.append(h)
            left_out.append(chunk[:, left[0]].astype(np.int32) + 1 if number and len(left) == 1 else np.zeros(len(chunk), np.int32))
    return np.column_stack(out).view(np.int64), np.column_stack(left_out)


def keyed(classes: DataFrame, p: Params, words: bool = False) -> DataFrame:
    """(rep, key) of classes (rep, sig), or (rep, key, word)."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16)
                key, word = keys(sig.reshape(len(part), p.symbols), p)
                offsets = pa.array(np.arange(len(part) + 1) * key.shape[1], pa.int32())
                out = {"rep": part.column("rep"), "keys": pa.ListArray.from_arrays(offsets, pa.array(key.ravel()))}
                if words:
                    out["words"] = pa.ListArray.from_arrays(offsets, pa.array(word.ravel()))
                yield pa.RecordBatch.from_pydict(out)

    made = classes.select("rep", "sig").mapInArrow(rows, "rep long, keys array<long>" + ", words array<int>" * words)
    if not words:
        return made.select("rep", F.explode("keys").alias("key"))
    return made.select("rep", F.explode(F.arrays_zip("keys", "words")).alias("k")).select("rep", F.col("k.keys").alias("key"), F.col("k.words").alias("word"))


def digested(found: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def described(docs: DataFrame, key: str, text: str, p: Params) -> DataFrame:
    """(id, n, digest, sig): size, digest and signature of each row's shingle set."""

    @F.arrow_udf("struct<n: long, digest: binary, sig: binary>")
    def describe(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        with released():
            for batch in parts:
                for part in slices(batch):
                    rows = []
                    for x in part.to_pylist():
                        found = shingles(x, p.shingle, words)
                        rows.append((len(found), digested(found), signature(found, p).tobytes() if len(found) else None))
                    n, digest, sig = zip(*rows) if rows else ((), (), ())
                    yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["n", "digest", "sig"])
                trim()
            words.clear()

    return docs.select(F.col(key).cast("long").alias("id"), describe(F.col(text)).alias("d")).select("id", "d.*")


def full_sets(docs: DataFrame, members: DataFrame, key: str, text: str, p: Params, repeated: bool) -> DataFrame:
    """(id, s): the full shingle sets of members (id, digest), which is materialised; once if ids are ``repeated``."""

    @F.arrow_udf("struct<s: array<long>, digest: binary>")
    def listed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words()
        with released():
            for batch in parts:
                for part in slices(batch):
                    found = [shingles(x, p.shingle, words).view(np.int64) for x in part.to_pylist()]
                    flat = np.concatenate(found) if found else np.zeros(0, np.int64)
                    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                    yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())), pa.array([digested(x) for x in found], pa.binary())], ["s", "digest"])
                trim()
            words.clear()

    texts = only(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("x")), ["id"], members)
    sets = texts.select("id", listed("x").alias("d")).select("id", "d.*")
    if repeated:
        sets = sets.join(members, ["id", "digest"], "left_semi").dropDuplicates(["id"])
    return sets.select("id", "s")


def owned(sets: DataFrame, p: Params) -> DataFrame:
    """(id, n, own, bits): the size of each set, how many of its shingles no other set has, and a bitmap
    of ``p.cells`` bits with the cells that the rest fall in by their hash."""

    @F.arrow_udf("array<long>")
    def bitmap(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for each in parts:
            out = np.zeros((len(each), p.cells), np.uint8)
            for k, x in enumerate(each):
                out[k, x.values.to_numpy() & (p.cells - 1)] = 1
            offsets = pa.array(np.arange(len(each) + 1) * (p.cells // 64), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(np.packbits(out, axis=1).view(np.int64).ravel()))

    alone = sets.select("id", F.explode("s").alias("h")).groupBy("h").agg(F.count("id").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.collect_list("h").alias("alone"))
    both = sets.join(alone, "id", "left").withColumn("rest", F.when(F.col("alone").isNull(), F.col("s")).otherwise(F.array_except("s", "alone")))
    return both.select("id", F.size("s").cast("long").alias("n"), (F.size("s") - F.size("rest")).cast("long").alias("own"), bitmap("rest").alias("bits"))


def confirmed(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("i", shared).filter(F.col("i") * 100 >= p.percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def possible(p: Params, na, oa, nb, ob):
    """Whether sets of these sizes and numbers of own shingles can reach the similarity."""
    return reaches(p, F.least(F.col(na) - F.col(oa), F.col(nb) - F.col(ob)), na, nb)


def reaches(p: Params, shared, na, nb):
    return shared * 100 >= p.percent * (F.col(na) + F.col(nb) - shared)


def linkable(p: Params, g: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket's rows that differ in component and may reach the similarity.

    Rows of two blocks are compared across; of one block, each pair once. ``p.block`` rows meet at a time.
    """
    root, rep, word = g.root.to_numpy(), g.rep.to_numpy(), g.word.to_numpy()
    n, core, block = g.n.to_numpy(), (g.n - g.own).to_numpy(), g.block.to_numpy()
    bits = np.stack(g.bits.to_numpy()).view(np.uint64)
    one = block.max() == block.min()
    x, y = np.flatnonzero(block == block.max()), np.flatnonzero(block == block.min())
    for at in range(0, len(x), p.block):
        for to in range(0, len(y), p.block):
            i, j = (a.ravel() for a in np.meshgrid(x[at : at + p.block], y[to : to + p.block], indexing="ij"))
            ok = (root[i] != root[j]) & ((word[i] == 0) | (word[i] != word[j]))
            if one:
                ok &= rep[i] > rep[j]
            i, j = i[ok], j[ok]
            shared = np.minimum(core[i], core[j])
            ok = shared * 100 >= p.percent * (n[i] + n[j] - shared)
            i, j = i[ok], j[ok]
            left = np.zeros((2, len(i)), np.int64)  # cells of one that the other lacks: shingles that they don't share
            for w in range(bits.shape[1]):
                a, b = bits[i, w], bits[j, w]
                left[0] += np.bitwise_count(a & ~b)
                left[1] += np.bitwise_count(b & ~a)
            shared = np.minimum(core[i] - left[0], core[j] - left[1])
            ok = shared * 100 >= p.percent * (n[i] + n[j] - shared)
            if ok.any():
                yield i[ok], j[ok]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links, ``kept`` marks the document of that id.
    """
    facts = stored(described(docs, key, text, p), "sets")
    usable = facts.filter((F.col("n") > 0) & F.col("id").isNotNull())
    repeats = stored(facts.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("id").alias("c"), F.min("digest").alias("chosen")).filter("c > 1 and chosen is not null").drop("c"), "repeats")
    repeated = not repeats.isEmpty()
    if repeated:  # of each id the rows with its smallest digest count
        plain, several = lookup(usable, ["id"], repeats)
        usable = plain.unionByName(several.filter(F.col("chosen").isNull() | (F.col("chosen") == F.col("digest"))).drop("chosen"))
    classes = stored(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count("id").alias("count"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    keyed_by = keyed(classes, p)
    # Partial aggregation and a join, which Spark can split, keep a hot key from one task.
    shared = keyed_by.groupBy("key").agg(F.min("rep").alias("r0"), F.max("rep").alias("r1")).filter("r0 < r1").select("key")
    buckets = stored(keyed_by.join(shared, "key"), "buckets")
    members = stored(classes.select(F.col("rep").alias("id"), "digest").join(buckets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "members")
    sets = stored(full_sets(docs, members, key, text, p, repeated), "full")
    sized = stored(owned(sets, p).withColumnRenamed("id", "rep").filter((F.col("n") - F.col("own")) * 100 >= p.percent * F.col("n")), "own")
    buckets = stored(buckets.join(sized.drop("bits"), "rep"), "sized")

    hubs = buckets.groupBy("key").agg(F.min(F.struct("own", "rep", "n")).alias("hub"))
    spokes = buckets.join(hubs, "key").select(F.col("rep").alias("a"), "n", "own", F.col("hub.rep").alias("b"), F.col("hub.n").alias("hn"), F.col("hub.own").alias("ho"))
    spokes = cut(spokes.filter((F.col("a") != F.col("b")) & possible(p, "n", "own", "hn", "ho")).select("a", "b", "ho").distinct())
    # One comparison a member, then the other hubs.
    links = confirmed(spokes.groupBy("a").agg(F.min(F.struct("ho", "b")).alias("h")).select("a", F.col("h.b").alias("b")), sets, p)
    label = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    label = grown(label, confirmed(apart(spokes.select("a", "b"), label), sets, p))
    # Within buckets of several components.
    label = grown(label, confirmed(crossed(buckets, classes.select("rep", "sig").join(sized, "rep"), label, p), sets, p))

    # Classes of one row need no join: its id is the representative.
    known = classes.filter("count > 1").select("digest", "count", "rep")
    if repeated:
        plain, several = lookup(facts, ["id"], repeats)
        facts = plain.withColumn("of", F.col("digest")).unionByName(several.withColumn("of", F.coalesce("chosen", "digest")).drop("chosen"))
    else:
        facts = facts.withColumn("of", F.col("digest"))
    ends = by_class(facts.select("id", "n", "of"), "of", stored(known.withColumnRenamed("digest", "of"), "known"), "id")
    ends = ends.withColumn("rep", F.coalesce("rep", "id"))
    label = stored(label.select(F.col("node").alias("rep"), "root"), "label")
    rooted_by = label.join(classes.select("rep", "count"), "rep")
    ends = by_class(ends.drop("of"), "rep", stored(rooted_by, "roots"), "id")
    ends = ends.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))
    return ends.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def rooted(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components of both ends as (ra, rb)."""
    left, right = label.select(F.col("node").alias("a"), F.col("root").alias("ra")), label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    return out.withColumn("ra", F.coalesce("ra", "a")).withColumn("rb", F.coalesce("rb", "b"))


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return rooted(pairs, label).filter(F.col("ra") != F.col("rb")).select("a", "b")


def grown(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: links join components, so only their roots form the next graph."""
    links = cut(links)
    if links.isEmpty():
        return label
    ends = rooted(links, label)
    roots = cut(components(ends.select(F.col("ra").alias("u"), F.col("rb").alias("v"))))
    moved = label.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = roots.join(label.select("node"), "node", "left_anti")
    return cut(moved.unionByName(new))


def crossed(buckets: DataFrame, members: DataFrame, label: DataFrame, p: Params) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a bucket, as far as a link is possible.

    A bucket is dealt to blocks of about ``p.block`` rows, or ``p.grid`` of them, and a task holds two at a time.
    """
    placed = buckets.select("key", "rep").join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", F.coalesce("root", "rep").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.least(F.lit(p.grid), F.ceil(F.count("root") / p.block)).cast("int").alias("blocks")).filter("r0 < r1").select("key", "blocks")
    facts = members.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rows = keyed(members, p, words=True).join(several, "key").join(facts.select("rep", "n", "own", "root", "bits"), "rep")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rows = rows.withColumn("x", F.greatest("block", "other")).withColumn("y", F.least("block", "other"))

    def pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # here alone, as it takes much of a worker's memory

        held = None
        for part in chain(parts, [None]):
            if part is not None:
                held = part if held is None else pd.concat([held, part], ignore_index=True)
            if held is None or not len(held):
                continue
            same = [held[c].to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in same], axis=0)) + 1
            ends = [*cuts, len(held)] if part is None else cuts
            out, at = [], 0
            for end in ends:
                if end - at > 1:
                    g = held.iloc[at:end]
                    rep = g.rep.to_numpy()
                    out += [np.stack([np.maximum(rep[i], rep[j]), np.minimum(rep[i], rep[j])], axis=1) for i, j in linkable(p, g)]
                at = end
            held = held.iloc[at:]
            if out:
                found = np.unique(np.concatenate(out), axis=0)
                yield pd.DataFrame(found, columns=["a", "b"])

    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInPandas(pairs, "a long, b long").distinct()
