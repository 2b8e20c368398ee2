"""The ``papers`` view over the documents table, and compaction of a harvest log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The stand-in view's categories, by the remainder of the document's number.
CATEGORIES = ("cs.AI", "cs.LG", "cs.CL", "cs.CV", "cs.NE", "stat.ML", "cs.RO", "cs.IR")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers made of ``documents``: the first line as title, the rest as abstract, derived dates and categories."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = F.array(*map(F.lit, CATEGORIES))
    number = F.col("doc_id").cast("long")
    first, second = F.get(names, (number % 8).cast("int")), F.get(names, (F.floor(number / 8).cast("long") % 8).cast("int"))
    since = F.lit("2017-01-01").cast("date")
    day = ((number * 37) % 3500).cast("int")
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120)
    rows = docs.select("doc_id", "text", "lang", "source", F.date_add(since, day).cast("string").alias("published"), F.date_add(since, day + (number % 3 * 30).cast("int")).cast("string").alias("updated"), title.alias("title"), F.array_distinct(F.array(first, second)).alias("categories"))
    paper_id = F.concat(F.substring("published", 3, 2), F.substring("published", 6, 2), F.lit("."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    abstract = F.trim(F.substring(F.col("text"), F.length("title") + 1, F.length("text")))
    return rows.select("doc_id", paper_id.alias("id"), "title", abstract.alias("abstract"), F.array("source", "lang").alias("authors"), "categories", "published", "updated")


def in_scope(rows: DataFrame, categories) -> DataFrame:
    return rows.filter(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def compact(log: DataFrame, order: list[str], categories=(), key: str = "id") -> DataFrame:
    """One record a key, the last in the log whatever its date; then deleted and out-of-scope ones go.

    The winner is picked first: an older live record of a withdrawn paper must not come back.
    """
    last = log.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")
    live = last.filter(~F.coalesce("deleted", F.lit(False)))
    return in_scope(live, categories) if categories else live
