"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of ``documents``;
the last returns token ids. Decisions: texts in no learned language go,
that is without a letter or with a score below what training texts of the predicted language reach; one
document of each group of near copies stays, that of the smallest id, and one row of equal texts under one id,
or under none; documents that hold a passage of the benchmark go; secrets are
replaced in the text; what is left is encoded, and decoding is checked to give the text again.

Nulls, empty texts, repeated rows and empty tables are handled as the operators' modules define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, decontam, joins, langid, neardup, secrets
from folioscan.llm.common import stored
from folioscan.llm.queries import VOCABULARY, fold
from folioscan.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The rows' texts differ stage by stage, so no SQL states them: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in no learned language go; a missing language becomes the predicted one."""
    ship(spark)
    training = docs.filter(~fold("doc_id", 4, 2))
    filters = langid.fit(training)
    found = langid.detect(docs.select(*COLUMNS), filters).filter(langid.known(langid.floors(training, filters)))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    gone = stored(neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = joins.without(docs.select(*COLUMNS), ["doc_id"], gone)
    # Rows that repeat an id, and those without one: of equal texts the smallest row stays.
    again = stored(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    smallest = joins.only(left, ["doc_id"], again).groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "text", "r.*")
    return joins.without(left, ["doc_id"], again).unionByName(smallest)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    ship(spark)
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), extra=COLUMNS[1:])
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    ship(spark)
    found = secrets.scan(docs, extra=("lang", "source"))
    text = secrets.redacted(F.col("x"), F.col("spans")).alias("text")
    return found.select("doc_id", text, "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether decoding them gives the text."""
    ship(spark)
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS), path, pattern), path, pattern)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what one kept is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
