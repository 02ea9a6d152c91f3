import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from tremor.llm.pieces import load_pieces
from tremor.llm.queries import op2_token_counts
from tremor.llm.token_counts import UnigramCounter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
_model = pb.ModelProto()
with open(PATH, "rb") as _f:
    _model.ParseFromString(_f.read())
_model.trainer_spec.model_type = 1  # the same pieces and scores as a unigram model
LIB = sentencepiece.SentencePieceProcessor(model_proto=_model.SerializeToString())
OWN = UnigramCounter(load_pieces(PATH))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aeinrst ▁\n.,thé漢", max_size=60)), min_size=1, max_size=6))
def test_equals_library(texts):
    assert OWN.counts(texts).tolist() == [len(LIB.nbest_encode_as_ids(t, 1)[0]) if t else 0 for t in texts]


def whole(word):
    """One word's count without a trie."""
    score, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        options = [(score[s] + OWN.score[word[s:end]], -s, count[s] + 1) for s in range(end) if word[s:end] in OWN.score]
        if word[end - 1] not in OWN.score:
            options.append((score[end - 1] + OWN.unknown, 1 - end, count[end - 1] + len(word[end - 1].encode())))
        best = max(options)
        score.append(best[0])
        count.append(best[2])
    return count[-1]


def test_query_equals_brute_force(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    memo = {}
    for r in op2_token_counts(spark, sf_small).collect():
        words = ["▁" + w for w in docs[r.doc_id].split(" ")] if docs[r.doc_id] else []
        assert "  " in docs[r.doc_id] or r.n_tokens == sum(memo.setdefault(w, whole(w)) for w in words)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 50_000), (3, "x" * 3000), (4, "  a  b ")]
    out = count_tokens(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, N_TOKENS string"), PATH)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    assert [r.n_tokens for r in out.collect()] == OWN.counts([t or "" for _, t in rows]).tolist()
    assert count_tokens(out.limit(0), PATH).collect() == []
