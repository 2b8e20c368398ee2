"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Largest inner products become smallest distances by one more dimension, ``sqrt(M^2 - |x|^2)`` with M
the largest norm (0 for queries). Vectors are dealt to the lists of their nearest centroid; centroids
come from a bounded sample, while every vector is indexed. The vectors, rotated by a random orthogonal
matrix, are read in blocks of columns: after ``d`` of ``D`` columns a candidate is abandoned when its partial
distance, scaled by ``D / d``, exceeds the query's bound by the factor ``(1 + epsilon / sqrt(d))^2`` (the
hypothesis test of ADSampling, Gao and Long, 2023). Survivors get their inner product of the original
vectors in double precision.

Bounds come from scanned vectors alone, nearest lists first, in waves. A query's nearest lists, which hold k
other vectors together, are scanned whole; the k-th of what they give bounds the scan of the next lists, up to a
64th of those that it probes, the k-th then those up to an eighth, and so the rest. Within a task it falls further as lists
are scanned one after the other. All rows come from scanned lists. Lists are
packed into cells of about ``block`` vectors, larger ones are dealt to several; a cell's task meets the
queries that probe a list of it, in blocks of ``block`` too, and a query is sent once to a cell.

Probed lists are as many as queries need for ``recall`` on the sample, where exact search is cheap, and
at least as many as hold k vectors. There are ``4 sqrt(n)`` lists, as far as the sample allows: with
finer lists the probed share falls.

Defined results: null, empty or zero vectors, those with null or non-finite components and those of
a length other than the commonest one take no part, neither as queries nor as candidates; rows of one
id are one vector, the smallest in array order; ties in score go to the smaller id; with fewer than k
other vectors, all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


#: The waves of lists that a query probes, nearest first: those that hold k vectors, then up to a part of them all.
WAVES = {"first": None, "next": 1 / 64, "more": 1 / 8, "others": 1}


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the vectors that centroids are fitted on, and as many others that probes are fitted on; ``block`` the vectors, and the queries, of a task."""

    k: int = 20
    lists: int | None = None
    sample: int = 8_192
    recall: float = 0.95
    tuned: int = 256
    columns: int = 16
    epsilon: float = 2.1
    block: int = 2_048
    seed: int = 7


@dataclass(frozen=True)
class Index:
    p: Params
    norm: float
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sizes: np.ndarray  # vectors of each list

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The first cell of each list, and how many it is dealt to: large lists to their own, others packed together."""
        first, many = np.zeros(len(self.sizes), np.int64), np.maximum(1, -(-self.sizes // self.p.block))
        at, held = -1, self.p.block
        for k, n in enumerate(self.sizes):
            if many[k] > 1 or held + n > self.p.block:
                at, held = at + 1, 0
            first[k] = at
            if many[k] > 1:
                at, held = at + many[k] - 1, self.p.block
            held += n
        return first, many


def augment(x: np.ndarray, norm: float | None) -> np.ndarray:
    """Vectors with the dimension that makes inner products distances; ``norm`` None: queries."""
    last = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.column_stack([x, last])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin(squared(x, c), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors that take part, of the commonest length, one for each id."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.coalesce(F.exists("v", bad), F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common:
        rows = rows.filter(F.size("v") == common[0])
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def build(rows: DataFrame, p: Params = Params()) -> tuple[Index, DataFrame] | None:
    """Fit on the sample and deal every vector to its list: (id, v, list). None without vectors."""
    spark = rows.sparkSession
    norm_sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, most = rows.agg(F.count("id"), F.max(norm_sq)).first()
    if not n:
        return None
    norm = float(np.sqrt(most))
    part = F.pmod(F.xxhash64(F.lit(p.seed), "id"), F.lit(1 << 32))
    share = int(p.sample / n * (1 << 32))

    def drawn(low: int, high: int) -> np.ndarray:
        return np.stack(rows.filter((part >= low) & (part < high)).orderBy("id").toPandas().v.to_numpy())

    x = drawn(0, 1 << 32) if n <= p.sample else drawn(0, share)
    rng = np.random.default_rng(p.seed)
    lists = min(p.lists or max(1, int(4 * np.sqrt(n))), max(1, len(x) // 4))
    deep = augment(x, norm)
    c = kmeans(deep, lists, rng)
    # Lists that lie together are numbered together, so that they share cells.
    c = c[np.argsort(np.argmin(squared(c, kmeans(c, max(1, min(lists, int(n / p.block))), rng)), axis=1), kind="stable")]
    rotation = np.linalg.qr(rng.standard_normal((deep.shape[1],) * 2))[0]

    # Probes: the fewest lists that hold `recall` of the neighbours of sampled queries, among vectors that the centroids
    # weren't fitted on, as most vectors are.
    if n >= 1.25 * p.sample:
        x = drawn(share, min(2 * share, 1 << 32))
    own = np.argmin(squared(augment(x, norm), c), axis=1)
    tuned = rng.choice(len(x), min(p.tuned, len(x)), replace=False)
    dots = x[tuned] @ x.T
    dots[np.arange(len(tuned)), tuned] = -np.inf
    best = np.argsort(-dots, axis=1)[:, : min(p.k, len(x) - 1)]
    rank = np.argsort(np.argsort(squared(augment(x[tuned], None), c), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(p.recall * len(needed)))]) if len(needed) else lists

    sent = spark.sparkContext.broadcast((c, norm))

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, norm = sent.value
        for part in parts:
            if len(part):
                part["list"] = np.argmin(squared(augment(np.stack(part.v.to_numpy()), norm), c), axis=1)
                yield part

    table = stored(rows.mapInPandas(dealt, "id long, v array<double>, list int"), "lists")
    sizes = np.zeros(lists, np.int64)
    for k, m in table.groupBy("list").count().collect():  # a row for each list
        sizes[k] = m
    return Index(p, norm, c, rotation, probes, sizes), table


def survivors(x: np.ndarray, q: np.ndarray, bound: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``q``, row of ``x``) of the pairs that no block of columns shows to be farther than the query's ``bound``. Both rotated."""
    full = x.shape[1]
    partial, at = np.zeros((len(q), len(x))), 0
    while at < full:
        block = slice(at, min(at + p.columns, full))
        at = block.stop
        a, b = q[:, block], x[:, block]
        partial += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        keep = partial <= allowed(bound, at, full, p)[:, None]
        if np.count_nonzero(keep) * 4 < keep.size or at == full:
            break
    i, j = np.nonzero(keep)
    partial = partial[i, j]
    while at < full and len(i):  # few are left: they go on one by one
        block = slice(at, min(at + p.columns, full))
        at = block.stop
        partial = partial + ((q[i, block] - x[j, block]) ** 2).sum(axis=1)
        keep = partial <= allowed(bound, at, full, p)[i]
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def allowed(bound: np.ndarray, d: int, full: int, p: Params) -> np.ndarray:
    """What a partial distance over ``d`` of ``full`` columns may be."""
    return (bound if d == full else bound * d / full * (1 + p.epsilon / np.sqrt(d)) ** 2) + 1e-9


class Best:
    """The ``k`` largest scores so far of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Pairs in order of the query's row ``i``."""
        n, k = self.score.shape
        rows, first, many = np.unique(i, return_index=True, return_counts=True)
        if not len(rows):
            return
        # A row for each query met: what it has, then its new pairs, padded.
        wide = np.full((len(rows), k + many.max()), -np.inf)
        names = np.full(wide.shape, np.iinfo(np.int64).max)
        wide[:, :k], names[:, :k] = self.score[rows], self.id[rows]
        r = np.repeat(np.arange(len(rows)), many)
        c = k + np.arange(len(i)) - np.repeat(first, many)
        wide[r, c], names[r, c] = score, ids
        order = np.lexsort((names, -wide), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(wide, order, 1), np.take_along_axis(names, order, 1)


def scanned(ix: Index, vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """(query_id, vec_id, score): each query's ``k`` best of a cell's vectors, in the lists that it probes."""
    p, columns = ix.p, ["query_id", "vec_id", "score"]
    if not len(vectors) or not len(asked):
        return pd.DataFrame(columns=columns)
    vectors = vectors.sort_values(["list", "id"])
    x, ids, own = np.stack(vectors.v.to_numpy()), vectors.id.to_numpy(), vectors["list"].to_numpy()
    q, names = np.stack(asked.v.to_numpy()), asked.id.to_numpy()
    turned, deep = augment(x, ix.norm) @ ix.rotation, augment(q, None) @ ix.rotation
    most = (deep * deep).sum(axis=1) + ix.norm**2  # a squared distance is this less twice the inner product
    best = Best(len(q), p.k)
    probed = np.repeat(np.arange(len(q)), asked.lists.map(len)), np.concatenate(asked.lists.to_numpy())
    at, ends = np.unique(own, return_index=True)
    for k, a, b in zip(at, ends, [*ends[1:], len(own)]):
        mine = probed[0][probed[1] == k]
        if not len(mine):
            continue
        bound = np.minimum(asked.bound.to_numpy()[mine], most[mine] - 2 * best.score[mine, -1])
        i, j = survivors(turned[a:b], deep[mine], bound, p)
        ok = ids[a:b][j] != names[mine[i]]
        i, j = mine[i[ok]], a + j[ok]
        score = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            score[s : s + (1 << 16)] = (x[j[s : s + (1 << 16)]] * q[i[s : s + (1 << 16)]]).sum(axis=1)
        best.add(i, ids[j], score)
    i, c = np.nonzero(best.score > -np.inf)
    return pd.DataFrame({"query_id": names[i], "vec_id": best.id[i, c], "score": best.score[i, c]})


def met(table: DataFrame, ix: Index, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of queries (id, v, bound, lists) with the vectors of these lists."""
    first, many = ix.cells()
    p = ix.p
    spark = table.sparkSession
    cells = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype=np.int32), "first": first, "many": many})))  # a row for each list
    placed = table.join(cells, "list").select("id", "v", "list", (F.col("first") + F.pmod(F.xxhash64(F.lit(1), "id"), "many")).alias("cell"))
    each = asked.select("id", F.explode("lists").alias("list")).join(cells, "list")
    each = each.select("id", "list", F.explode(F.sequence("first", F.col("first") + F.col("many") - 1)).alias("cell"))
    by_cell = each.groupBy("id", "cell").agg(F.collect_list("list").alias("lists"))  # a cell's lists at most
    # Many queries may meet in one cell: they are dealt to blocks by a hash, and its vectors go to each of them.
    blocks = stored(each.groupBy("cell").agg(F.ceil(F.count_distinct("id") / p.block).cast("int").alias("blocks")), "blocks")
    by_cell = by_cell.join(blocks, "cell").select("id", "cell", "lists", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    sides = asked.select("id", "v", "bound").join(by_cell, "id")
    placed = placed.join(blocks, "cell").select("id", "v", "list", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    sent = spark.sparkContext.broadcast(ix)

    def task(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return scanned(sent.value, vectors, asked)

    return placed.groupBy("cell", "block").cogroup(sides.groupBy("cell", "block")).applyInPandas(task, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of the table's vectors to each of ``queries`` (id, v), itself left out."""
    p = index.p
    sent = table.sparkSession.sparkContext.broadcast(index)

    def probed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                near = np.argsort(squared(augment(np.stack(some.v.to_numpy()), None), ix.centroids), axis=1).astype(np.int32)
                held = np.cumsum(ix.sizes[near], axis=1)
                first = np.minimum(1 + (held < ix.p.k + 1).sum(axis=1), near.shape[1])  # these lists hold k others together
                depth = np.maximum(ix.probes, first)
                edges = [[0, *(max(first[j], int(depth[j] * (part or 0))) for part in WAVES.values())] for j in range(len(some))]
                lists = {name: [near[j, e[k] : e[k + 1]] for j, e in enumerate(edges)] for k, name in enumerate(WAVES)}
                yield pd.DataFrame({"id": some.id.to_numpy(), "v": some.v.to_numpy()} | lists)

    asked = stored(queries.mapInPandas(probed, "id long, v array<double>, " + ", ".join(f"{w} array<int>" for w in WAVES)), "asked")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + index.norm**2
    found = None
    for wave in WAVES:
        now = asked.filter(F.size(wave) > 0).withColumn("lists", F.col(wave))
        if found is None:
            found = met(table, index, now.select("id", "v", F.lit(float("inf")).alias("bound"), "lists"))
        else:  # bounded by the distance of the k-th vector so far
            last = found.filter(F.col("rank") == p.k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            now = now.join(last, "id", "left").select("id", "v", F.coalesce(square - 2 * F.col("kth"), F.lit(float("inf"))).alias("bound"), "lists")
            found = found.select("query_id", "vec_id", "score").unionByName(met(table, index, now))
        found = ranked(found, p.k)
        if wave != "others":
            found = stored(found, wave)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries=None, key: str = "vec_id", vector: str = "embedding", p: Params = Params()) -> DataFrame:
    """Index all vectors and search them; ``queries`` is a condition on ``key`` (default: every row)."""
    rows = stored(usable(vectors, key, vector), "vectors")
    built = build(rows, p)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, table = built
    asked = rows if queries is None else rows.filter(queries(F.col("id")))
    return search(table, index, asked)
