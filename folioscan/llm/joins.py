"""Joins of large rows with small ones, without shuffling rows that meet nothing, or a hot key to one task.

``flagged`` tells by a bitmap of hashed keys whether a row can meet any of a table's rows. The bitmap is
broadcast; it has at most ``2 ** MOST_BITS`` bits (8 MB) whatever the table's size. Only flagged rows
are shuffled, and joined exactly. ``by_class`` joins rows with a table of one row per key that knows the
key's number of rows: at most ``HOT`` keys, the largest, are broadcast; any other key has at most a
share of ``1 / HOT`` of all rows, or ``LEAST`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS, LEAST_BITS = 26, 15
HOT, LEAST = 50_000, 64


def flagged(rows: DataFrame, on: list[str], keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """Add ``name``: False only where no row of ``keys`` (materialised) has the row's values of ``on``; nulls are values."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * n + 1))))
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    marks = keys.select(place.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    at = F.bitmap_bit_position("_h")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    found = rows.withColumn("_h", place).withColumn("_bucket", F.bitmap_bucket_number("_h")).join(F.broadcast(marks), "_bucket", "left")
    return found.withColumn(name, marked).drop("_h", "_bucket", "_bits")


def equal(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    """Equality of the columns ``on`` of two frames, nulls being equal."""
    cond = F.lit(True)
    for c in on:
        cond &= left[c].eqNullSafe(right[f"_{c}"])
    return cond


def lookup(rows: DataFrame, on: list[str], table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that surely meet nothing, the others left-joined with ``table``), of a materialised table with a row per key."""
    told = flagged(rows, on, table.select(*on))
    other = table.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in table.columns])
    maybe = told.filter("_maybe").drop("_maybe")
    return told.filter("not _maybe").drop("_maybe"), maybe.join(other, equal(maybe, other, on), "left").drop(*[f"_{c}" for c in on])


def only(rows: DataFrame, on: list[str], table: DataFrame) -> DataFrame:
    """The rows whose key a materialised table has."""
    maybe = flagged(rows, on, table.select(*on)).filter("_maybe").drop("_maybe")
    other = table.select(*[F.col(c).alias(f"_{c}") for c in on])
    return maybe.join(other, equal(maybe, other, on), "left_semi")


def without(rows: DataFrame, on: list[str], table: DataFrame) -> DataFrame:
    """The rows whose key a materialised table lacks."""
    told = flagged(rows, on, table.select(*on))
    maybe, other = told.filter("_maybe").drop("_maybe"), table.select(*[F.col(c).alias(f"_{c}") for c in on])
    return told.filter("not _maybe").drop("_maybe").unionByName(maybe.join(other, equal(maybe, other, on), "left_anti"))


def hot_from(table: DataFrame, count: str = "count", least: int = LEAST) -> int:
    """The least number of rows of a hot key, a power of two from ``least`` on: at most ``HOT`` keys have so many."""
    sizes = dict(table.groupBy(F.floor(F.log2(count)).cast("int").alias("k")).count().collect())
    k, total = 63, 0
    while k > math.log2(least) and total + sizes.get(k - 1, 0) <= HOT:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


def by_class(rows: DataFrame, key: str, table: DataFrame, spread: str, count: str = "count") -> DataFrame:
    """``rows`` left-joined with a materialised ``table`` of one row per non-null ``key`` and ``count`` rows of it.

    ``spread`` is a column that deals rows which need no shuffle join. The table's other columns must not be in ``rows``.
    """
    least = hot_from(table, count)
    others = [c for c in table.columns if c not in (key, count)]
    hot = table.filter(F.col(count) >= least).select(F.col(key).alias("_k"), F.struct(*others).alias("_hot"))
    cold = table.filter(F.col(count) < least).select(F.col(key).alias("_k"), F.lit(0).cast("long").alias("_s"), F.struct(*others).alias("_cold"))
    told = rows.join(F.broadcast(hot), rows[key] == F.col("_k"), "left").drop("_k")
    told = told.withColumn("_t", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0)))
    met = told.join(cold, (told[key].eqNullSafe(cold["_k"])) & (told["_t"] == cold["_s"]), "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in others])
