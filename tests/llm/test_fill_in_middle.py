import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm.fill_in_middle import RankIndex, boundaries, fill_in_middle, restored
from tremor.llm.queries import op11_fill_in_middle


def plain(key, text, seed=7, rate=100, spm=50):
    """The contract, read off the text by a pattern."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", "a", "\n", "\n\n\n", "a\n", "a\nb", "x<P>y\n", "<S", "S>\n<\nP>\n>", "é漢\U0001f600\n\r\nq\x0b\x85z\n", "w" * 5000 + "\n" + "v\n" * 400 + "u" * 900]


def _check(rows, out):
    for (key, text), r in zip(rows, out, strict=True):
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(key, text or "")
        assert r.back == (text or "")


def test_equals_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)]
    df = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    out = df.withColumn("back", restored(df.output, df.form)).orderBy("doc_id").collect()
    _check(rows, out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_query_equals_the_plain_version(spark, sf_small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op11_fill_in_middle(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in out:
        *head, text = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*head, sha(text), sha(docs[r.doc_id]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\n<PSM>é😀", max_size=60), min_size=1, max_size=8), st.sampled_from([0, 1, 127]))
def test_index_is_exact_and_bounded(texts, error):
    offsets, starts, lines = boundaries(texts)
    index = RankIndex.fit(offsets, starts, error)
    ranks = np.arange(len(offsets))
    assert np.array_equal(index.offset(ranks), offsets) and np.abs(index.residual).max() <= error
    assert lines.tolist() == [len(re.findall(r"[^\n]*\n|[^\n]+", t)) for t in texts]


def test_even_lines_need_one_segment_and_odd_ones_few_more():
    even = ["x" * 79 + "\n"] * 1000
    offsets, starts, _ = boundaries(["".join(even)])
    assert len(RankIndex.fit(offsets, starts).first) == 1
    offsets, starts, _ = boundaries(["".join(even) + "y" * 100_000 + "\n" + "".join(even)])
    assert 1 < len(RankIndex.fit(offsets, starts).first) < 40


def test_odd_rows(spark):
    rows = [(None, None, "p"), (None, "a\nb\nc\n", "q"), (1, "", "r"), (2, "line\n" * 300_000, None), (2, "line\n" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FORM string")
    df = fill_in_middle(docs)
    assert df.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = df.withColumn("back", restored(df.output, df.form)).collect()
    _check([("" if k is None else k, t) for k, t, _ in rows], out)
    assert out[3] == out[4] and out[0].output == ""
    assert fill_in_middle(docs.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc{i}\n" * (i % 5)) for i in range(200)], "doc_id long, text string")
    a, b = (sorted(map(str, fill_in_middle(d).collect())) for d in (docs.coalesce(1), docs.repartition(9)))
    assert a == b
