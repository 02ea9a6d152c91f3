import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.llm.piece_codec import PieceCodec, digests, encode_decode
from tremor.llm.pieces import load_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = PieceCodec(load_pieces(PATH))

FIXED = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "the.\nThe", "▁", "▁▁a ▁", "aaaaaaaaaaaaaaaaaaaaaaaa", "        x", "あ漢字 \U0001f600\U0001f600",
         "\x00\x01", "</s> <s> <unk> <0x41>", "ababababab", "thethethe the", "=" * 1001, "-=" * 77 + "…", "ß" * 50 + "ẞ", "\t\t  \t", "ing" * 400,
         "�", "é" * 9, "1234567890 0x00FF", "а" * 33 + "б"]


def ids_of(texts):
    import numpy as np

    return [np.frombuffer(b, "<i4").tolist() for b in CODEC.encode_texts(texts)]


def check(texts):
    for t, got in zip(texts, ids_of(texts), strict=True):
        assert got == [*LIB.encode(t), 2], t[:80]
        import numpy as np

        assert CODEC.decode_texts([np.array(got, "<i4").tobytes()]) == [LIB.decode(got)], t[:80]


def test_fixed_texts():
    check(FIXED)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst ▁\n.,thé漢", max_size=120), st.text(alphabet=" =-_a", max_size=80)), min_size=1, max_size=6))
def test_equals_library(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_decode_of_any_ids(ids):
    import numpy as np

    assert CODEC.decode_texts([np.array(ids, "<i4").tobytes()]) == [LIB.decode(ids)]


def test_documents(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = {r.doc_id: r for r in digests(encode_decode(df, PATH)).collect()}
    for r in df.collect():
        ids = [*LIB.encode(r.text or ""), 2]
        d = got[r.doc_id]
        assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert d.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "", "x"), (1, None, None), (1, "", "x"), (2, "long " * 60_000, "x")]])
def test_odd_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = encode_decode(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == [*LIB.encode(r.text or ""), 2] and r.decoded == (r.text or "")
    assert out.filter(F.size("ids") < 1).count() == 0


def test_query_equals_the_library(spark, sf_small):
    """op1_sentencepiece over the whole table: ids with the end id, and the text they decode to."""
    import hashlib

    import public_tokenizers
    import sentencepiece

    from tremor.llm.queries import op1_sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op1_sentencepiece(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        ids = lib.encode(docs[r.doc_id], add_bos=False, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))
