"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014).

Edges stay distributed; every round's edges are checkpointed, so lost executors cost no replay. A
star's centre is found by an aggregate with partial sums and joined back, so that a node of very many
edges is never collected into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v: each node's neighbours move to its smallest."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); ``root`` is the smallest node of its component.

    Loops, repeated edges and nulls are ignored; without edges the result is empty.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") > F.col("v"))).distinct()
    now, before = cut(now), None
    while True:
        state = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(stars(stars(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
