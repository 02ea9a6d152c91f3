import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremor.llm import token_files
from tremor.llm.queries import op10_token_files
from tremor.llm.token_files import WordEncoder, chunks, read_token_files, token_digests, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as _f:
    OWN = WordEncoder(_f.read())

FIXED = ["", " ", "  ", "a b", " a", "a ", "a  b", "a \n b", "it's we'll 's don 't", "x<|endoftext|> y <|endoftext|>", "a  b", "a 　b", "\n\n a",
         "1 234 5-6 _ __", "é è́ 漢字 かな \U0001f600 \U0001f600", "a\tb \t c", "x \x85y", "…  …", "a ​b", "a ᠎b", "a \x1cb", "a\x1f b"]


def check(texts):
    got = [np.frombuffer(b, "<i4").tolist() for b in OWN.encode_texts(texts, 2)]
    assert got == [[*LIB.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_fixed():
    check(FIXED)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=50), st.text(alphabet="ab1'. \n\t  é", max_size=60)), min_size=1, max_size=5))
def test_equals_library(texts):
    check(texts)


def want(rows):
    start, out = 0, []
    for k, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(map(tuple, op10_token_files(spark, sf_small).collect())) == want([tuple(r) for r in docs])


def test_odd_tables(spark, tmp_path):
    rows = [(None, "no key"), (3, None), (1, ""), (2, "w " * 50_000), (2, "same key"), (7, "x"), (7, "x")]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    write_token_files(df, str(tmp_path / "a"), PATH, 2)
    got = token_digests(read_token_files(spark, str(tmp_path / "a"))).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((k or 0, n) for k, _, n, _ in want(rows))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 7, 7]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    write_token_files(df.limit(0), str(tmp_path / "b"), PATH, 2)
    assert token_digests(read_token_files(spark, str(tmp_path / "b"))).collect() == []


def test_key_lookup_is_pushed_down(spark, tmp_path, sf_small):
    write_token_files(spark.read.parquet(f"{sf_small}/documents.parquet"), str(tmp_path / "t"), PATH, 2)
    one = read_token_files(spark, str(tmp_path / "t")).filter("doc_id = 5")
    assert one.count() == 1
    assert "EqualTo(doc_id,5)" in one._jdf.queryExecution().toString()


def test_equal_rows_are_spread_over_files(spark, tmp_path):
    """A third of the rows equal: no file holds much more than its share."""
    rows = [(5, "the same text")] * 3000 + [(i, f"text {i}") for i in range(6001) if i != 5]
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be joined into one file
    spark.conf.set(name, "false")
    try:
        write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), str(tmp_path / "t"), PATH, 2)
    finally:
        spark.conf.set(name, "true")
    files = read_token_files(spark, str(tmp_path / "t"))
    sizes = [r["count"] for r in files.groupBy("file_no").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) <= 2 * 9000 / len(sizes)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_digests(files).collect())
    assert got == sorted(want(sorted(rows)))


LINES = ["a\n\n<|endoftext|>", "a\n<|endoftext|>\nb", "a\n\n", "\n\nb", "\nb", "a\n\nb", "a\n\n\nb", "\n", "a\n", "a\r\n\r\nb, c", "\u0120 \u010a x\u0120\u010a",
         "don't, 12. 12., x1! \u0301, e\u0301, \u01bb.", "  a, b\n c", "...\n...", "a\u3000b c, d"]


@pytest.mark.parametrize("words, joined", [(900_000, 2048), (4, 8)])
def test_lines_marks_and_a_full_memory(monkeypatch, words, joined):
    monkeypatch.setattr(token_files, "MEMORY_WORDS", words)
    monkeypatch.setattr(token_files, "JOINED_BYTES", joined)
    for i in range(len(LINES)):
        check(LINES[i:] + LINES[:i:2])
        check(LINES[i:i + 1])


def test_words_do_not_show_where_they_begin():
    """A vocabulary without tokens of spaces or line feeds: words are encoded one by one."""
    lib = '{"version":"1.0","truncation":null,"padding":null,"added_tokens":[],"normalizer":null,"pre_tokenizer":%s,"post_processor":null,"decoder":null,"model":%s}' % (
        '{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true}',
        '{"type":"BPE","dropout":null,"unk_token":null,"continuing_subword_prefix":null,"end_of_word_suffix":null,"fuse_unk":false,"byte_fallback":false,'
        '"ignore_merges":false,"vocab":{"a":0,"b":1,"ab":2,",":3},"merges":[["a","b"]]}')
    texts = ["ab, ba\nab", "", "a  b", " ab\n\n"]
    want = [[*Tokenizer.from_str(lib).encode(t, add_special_tokens=False).ids, 9] for t in texts]
    assert [np.frombuffer(b, "<i4").tolist() for b in WordEncoder(lib).encode_texts(texts, 9)] == want


def test_repeated_words_are_not_handled_one_by_one():
    """Python's work follows the distinct words of a chunk, long ones too, not their occurrences."""
    def calls(n):
        seen, texts = [0], [" ".join(f"{'x' * 60}{'abcdefg'[i % 7]}," for i in range(n))]

        def count(frame, event, arg):
            seen[0] += event in ("call", "c_call")
        sys.setprofile(count)
        try:
            OWN.encode_texts(texts, 2)
        finally:
            sys.setprofile(None)
        return seen[0]
    calls(10)
    assert calls(20_000) < 2 * calls(200)


def test_chunks_hold_every_row_in_order():
    texts = ["x" * n for n in (0, 5, 900, 3, 3, 40, 40, 0, 2000, 1)] * 5 + [None]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts)})
    for step in (1, 7, len(texts)):
        got = list(chunks((rows.slice(i, step) for i in range(0, len(texts), step)), "text", 1000))
        assert pa.Table.from_batches(got).to_pylist() == rows.to_pylist()
        assert all(sum(len(t or "") for t in b.column(1).to_pylist()[:-1]) < 1000 for b in got) and len(got) < len(texts) / 2
    assert list(chunks(iter([rows.slice(0, 0)]), "text")) == []
