"""The pipeline against its stages' brute-force versions."""

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import bpe
from folioscan.llm.common import stored
from folioscan.llm.queries import VOCABULARY

from .test_operators import MEDIUM, contaminated, linked, read, secret_spans


def test_run(spark):
    docs = read("documents", MEDIUM)
    rows = [(d, t) for d, t in zip(docs.doc_id, docs.text) if t and any(map(str.isalpha, t))]
    component = linked(rows)
    rows = [(d, t) for d, t in rows if component[d][1] == d]
    hit = list(contaminated([t for _, t in rows], read("benchmark", MEDIUM).values.tolist()))
    rows = [r for r, (_, n, _) in zip(rows, hit) if not n]
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, MEDIUM).toPandas().set_index("doc_id")
    assert set(got.index) == {d for d, _ in rows} and got.round_trip.all()
    clean = 0
    for d, t in rows:
        if not secret_spans(t):
            clean += 1
            assert list(got.loc[d].ids) == tik.encode_ordinary(t)
        else:
            assert "REDACTED" in tik.decode(list(got.loc[d].ids))
    assert clean and len(corpus_pipeline.STAGES) == 5


def test_empty(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, MEDIUM)
        assert docs.count() == 0


def test_languages_that_were_not_learned_go(spark):
    """Other scripts, another language and gibberish go; all documents with a letter stay."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    clean = {d for d, t in zip(*[read("documents", MEDIUM)[c] for c in ("doc_id", "text")]) if t and any(map(str.isalpha, t))}
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю", "これは日本語の文章です。とても簡単です。", "Toto je česká věta o počasí a jídle", "xqzv jkwp zzxq vvkj qqwx"]
    more = spark.createDataFrame([(-1 - k, x, None, "s", len(x)) for k, x in enumerate(foreign)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(more), MEDIUM).collect()
    assert {r.doc_id for r in kept} == clean


def test_odd_rows(spark):
    """Nulls, repeats, ties and a very long text go through every stage, and equal rows stay once."""
    words = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, words("a"), "en", "s", 5), (1, words("a"), None, "r", None), (1, words("b"), "en", None, None), (None, words("c"), "en", None, 1), (None, words("c"), "en", None, 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, words("d") + " password = " + "k" * 40, "en", "s", 1), (4, words("e") * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1)).withColumn("spans", F.lit("x"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, MEDIUM), "odd")
        kept[name] = [(r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect()]
    assert sorted(kept["near duplicates"], key=str) == sorted([(1, "en"), (1, "en"), (None, "en"), (3, "en"), (4, "en")], key=str)
    assert len(kept["byte-level BPE"]) == 5 and docs.filter("not round_trip").count() == 0
