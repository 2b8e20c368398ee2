"""The registered queries of the operators, each over its whole table; their SQL is in ``oracles``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, divergence, html, langid, neardup, pieces, secrets, toxicity, variants, warc
from .oracles import ORACLES  # noqa: F401

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
FIXED_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, of: int, out: int):
    """Whether crc32 of an id as text leaves ``out``; rows without id are in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == out, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold("doc_id", 5, 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = toxicity.fit(docs.filter(~F.col("held_out")).join(labels, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    docs = bpe.decode(docs, path, pattern)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(FIXED_TURNS, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.read_back(chat.render(turns))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("phrases.item")))
    found = found.select("doc_id", "n_words", decontam.hit_words(F.col("hits")).alias("n_hit"), items.alias("items"), "near")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.concat_ws(",", "near").alias("near_items"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = secrets.written(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return found.select("doc_id", *map(count, base), F.sha2(own.cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 4, 2).alias("held_out"))
    filters = langid.fit(docs.filter(~F.col("held_out")))
    return langid.detect(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_index(warc.archive(table(spark, sf_dir, "pages")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), variants.Params(drop=199))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    docs = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_byte_bpe, op3_chat, op4_nearest, op5_html_text, op6_decontamination, op7_secrets, op8_near_duplicates, op9_language, op10_warc, op11_divergence, op12_variants, op13_sentencepiece)}
