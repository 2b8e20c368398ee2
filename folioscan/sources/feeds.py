"""Readers: harvested JSON lines, OAI-shaped XML records, index snapshots, exported state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

RECORD = "id string, datestamp string, title string, authors array<string>, categories array<string>, published string, updated string, abstract string, comment string, doi string, journalRef string, deleted boolean"

_AUTHOR = "struct<keyname: string, forenames: string>"
_TEXT = "id created updated title categories abstract comments doi journal-ref".split()
_BODY = ", ".join(f"`{name}`: string" for name in _TEXT)
FEED = f"header struct<_status: string, identifier: string, datestamp: string>, metadata struct<arXiv: struct<{_BODY}, authors: struct<author: array<{_AUTHOR}>>>>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Harvested records with their place in the log: (file, block, line) orders repeated ids. Torn and blank lines are skipped.

    ``line`` orders lines within a partition, so the order within a block holds as long as Spark gives a block to one
    partition, as its file sources do; ``block`` is where a file's block begins.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    parsed = lines.withColumn("r", F.from_json("value", RECORD + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.filter(F.col("r._corrupt").isNull() & F.col("r.id").isNotNull()).select("file", "block", "line", "r.*").drop("_corrupt")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of an XML feed: papers, or tombstones of deleted ones. Those without id, or title, are left out."""
    raw = spark.read.format("xml").option("rowTag", "record").schema(FEED).load(path)
    return records(raw)


def records(raw: DataFrame) -> DataFrame:
    m = F.col("metadata.arXiv")
    blank = lambda c: F.nullif(tx.collapse(F.coalesce(c, F.lit(""))), F.lit(""))
    name = lambda a: F.trim(F.concat_ws(" ", a["forenames"], a["keyname"]))
    rows = raw.select(
        F.coalesce(m["id"], F.element_at(F.split("header.identifier", ":"), -1)).alias("id"),
        F.coalesce("header.datestamp", F.lit("")).alias("datestamp"),
        tx.collapse(F.coalesce(m["title"], F.lit(""))).alias("title"),
        F.filter(F.transform(F.coalesce(m["authors"]["author"], F.expr(f"cast(array() as array<{_AUTHOR}>)")), name), lambda x: x != "").alias("authors"),
        F.array_remove(F.split(F.coalesce(m["categories"], F.lit("")), r"\s+"), "").alias("categories"),
        F.coalesce(m["created"], F.lit("")).alias("published"),
        m["updated"].alias("updated"),
        tx.collapse(F.coalesce(m["abstract"], F.lit(""))).alias("abstract"),
        blank(m["comments"]).alias("comment"),
        m["doi"].alias("doi"),
        blank(m["journal-ref"]).alias("journalRef"),
        F.coalesce(F.col("header._status") == "deleted", F.lit(False)).alias("deleted"),
    )
    return rows.filter(F.col("id").isNotNull() & (F.col("deleted") | (F.col("title") != "")))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An exported state document; it must say ``schema`` 1."""
    doc = spark.read.option("multiLine", True).json(path)
    if "schema" not in doc.columns or doc.filter(F.col("schema") == 1).isEmpty():
        raise ValueError(f"{path} is no export of schema 1")
    return doc
