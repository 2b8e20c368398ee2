"""Index snapshots: an immutable folder per build, partitioned as lookups prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.index import ID_FILTERS, Index, id_shards


def write_snapshot(index: Index, path: str) -> None:
    """Display chunks, metadata by month, ids by shard, the recent feed, postings by shard, and the manifest last.

    A reader that finds a manifest finds all of its build.
    """
    docs = index.docs
    light = docs.select("chunk", "doc_id", "id", "title", "authors", "categories", "published", "updated")
    light.repartition("chunk").sortWithinPartitions("chunk", "doc_id").write.partitionBy("chunk").parquet(f"{path}/docs")
    meta = docs.select(F.regexp_replace(F.substring("published", 1, 7), "-", "").alias("month"), "doc_id", "id", "abstract", "comment", "doi", "journal_ref")
    meta.repartition("month").write.partitionBy("month").parquet(f"{path}/meta")
    id_shards(docs).write.options(**ID_FILTERS).partitionBy("id_shard").parquet(f"{path}/ids")
    recent(index).coalesce(1).write.parquet(f"{path}/recent")
    index.postings.repartition("shard").sortWithinPartitions("shard", "term", "doc_id").write.partitionBy("shard").parquet(f"{path}/postings")
    index.terms.write.parquet(f"{path}/terms")
    index.manifest.coalesce(1).write.parquet(f"{path}/manifest")


def recent(index: Index) -> DataFrame:
    return index.docs.filter(F.col("doc_id") < index.config.recent_size).select("doc_id", "id", "title", "authors", "categories", "published", "updated")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The one-row manifest; an absent or empty one is an error, not an empty index."""
    manifest = spark.read.parquet(f"{path}/manifest")
    if manifest.isEmpty():
        raise ValueError(f"{path} has no manifest")
    return manifest


def read_postings(spark: SparkSession, path: str, terms: list[str], prefix_length: int = 2) -> DataFrame:
    """Postings of some terms, from the shards that hold them; an absent shard is an empty one."""
    import re

    shards = sorted({re.sub("[^a-z0-9]", "_", t[:prefix_length]) for t in terms})
    postings = spark.read.option("basePath", f"{path}/postings").schema("term string, doc_id long, mask int, weight int, shard string").parquet(f"{path}/postings")
    return postings.filter(F.col("shard").isin(*shards) & F.col("term").isin(*terms))


def read_docs(spark: SparkSession, path: str, chunks: list[int] | None = None) -> DataFrame:
    """Display rows of some chunks, or of all."""
    docs = spark.read.parquet(f"{path}/docs")
    return docs if chunks is None else docs.filter(F.col("chunk").isin(*chunks))


def details(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Display rows with the metadata of their months; where that is absent the abstract is empty, the rest null.

    They meet by number, as papers may share an identifier.
    """
    meta = spark.read.schema("doc_id long, abstract string, comment string, doi string, journal_ref string, month string").parquet(f"{path}/meta")
    rows = docs.withColumn("month", F.regexp_replace(F.substring("published", 1, 7), "-", ""))
    return rows.join(meta, ["month", "doc_id"], "left").withColumn("abstract", F.coalesce("abstract", F.lit(""))).drop("month")


def find_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, doc_id) of identifiers, versions left off; unknown ones are null."""
    # With a schema, as shards such as 2402 would be read as numbers.
    return look_up(spark.read.schema("id string, doc_id long, id_shard string").parquet(f"{path}/ids"), ids)


def look_up(known: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, doc_id) of identifiers in a table by ``id_shard``: shards that none is in aren't read; unknown and blank ones are null."""
    asked = ids.select("id", tx.strip_version(F.col("id")).alias("bare")).withColumn("s", tx.id_shard_key(F.col("bare")))
    there = known.select("id_shard", F.col("id").alias("known"), "doc_id")
    # The condition on what is asked lets Spark prune the other side's partitions by it.
    named = F.length("bare") > 0
    found = asked.filter(named).join(there, (F.col("s") == F.col("id_shard")) & (F.col("bare") == F.col("known")), "left").select("id", "doc_id")
    return found.unionByName(asked.filter(~F.coalesce(named, F.lit(False))).select("id", F.lit(None).cast("long").alias("doc_id")))
