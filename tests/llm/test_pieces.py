"""SentencePiece encoding and decoding against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import pieces, queries

from ..conftest import SMALL

PATH = public_tokenizers.path(queries.PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.Codec(pieces.Model(PATH))


@settings(max_examples=1500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" ▁\n\t.,aeinrstABz0129=-_é日🙂　ᚠ")), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encodes_as_the_library(text):
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text).tolist() == ids
    assert CODEC.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31_999), st.sampled_from([0, 1, 2, 259, 29871, 0xE2 + 3, 0x82 + 3, 0xAC + 3]))))
def test_decodes_any_ids_as_the_library(ids):
    assert CODEC.decode(np.array(ids, np.int32)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["ab" * 60_000, " " * 5_001, "=" * 40_000 + "é" * 999, "x" + "ᚠ" * 20_000, "a\n" * 30_000])
def test_long_texts(text):
    assert CODEC.encode(text).tolist() == LIBRARY.encode(text)


def test_every_prefix_has_its_last_token():
    text = "▁internationalisation▁▁▁of==theᚠse"
    last = CODEC.last_tokens(text)
    for end in range(1, len(text) + 1):
        parts = CODEC.merged(text[:end])
        assert parts[-1] == (CODEC.model.pieces[last[end]] if last[end] >= 0 else chr(~last[end]))


def test_query_is_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def test_odd_rows(spark):
    """Nulls, empty, long and repeated texts, columns that clash; no rows."""
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "z" * 70_000), (3, "z" * 70_000), (None, "▁ ▁")], "doc_id long, text string")
    rows = rows.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(0)).withColumn("size", F.lit(1))
    coded = pieces.decode(pieces.encode(rows, PATH), PATH)
    assert set(coded.columns) == {"doc_id", "text", "ids", "decoded", "size"}
    for r in coded.collect():
        ids = LIBRARY.encode(r.text or "")
        assert r.ids == ids and r.decoded == LIBRARY.decode(ids)
    assert pieces.decode(pieces.encode(rows.limit(0), PATH), PATH).count() == 0
    nulls = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode(nulls, PATH).first().decoded == ""


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as files

    proto = files.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.name = "nmt_nfkc"
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "other.model"))
