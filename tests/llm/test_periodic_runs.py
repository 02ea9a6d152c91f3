import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm.periodic_runs import find_runs, runs_of
from tremor.llm.queries import op12_periodic_runs


def brute(words, least=24, exponent=3):
    """Every run by trying every period; a stretch is kept under its smallest period."""
    ids = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    n, best = len(ids), {}
    for q in range(1, n // exponent + 1):
        equal = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        edges = np.flatnonzero(np.diff(equal))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a + q >= max(least, exponent * q):
                best.setdefault((int(a), int(b - a + q)), q)
    return sorted((a, size, q) for (a, size), q in best.items())


def found(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for d in docs for w in d], np.int64)
    out = [[] for _ in docs]
    for d, *run in runs_of(ids, sizes).tolist():
        out[d].append(tuple(run))
    return out


def _document(r):
    """Nested and neighbouring repetitions of blocks over a small alphabet, between other words."""
    words = []
    for _ in range(r.randint(1, 5)):
        block = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30, 33, 50, 64, 70, 100, 129]))]
        if r.random() < 0.3:
            block = block[:3] * r.randint(1, 20) + block
        words += block * r.randint(1, 6) + block[:r.randint(0, len(block))]
        if r.random() < 0.5:
            words += [f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 40))]
    return words


@pytest.mark.parametrize("seed", range(12))
def test_equals_brute_force_on_nested_repetitions(seed):
    r = random.Random(seed)
    docs = [_document(r) for _ in range(25)]
    assert found(docs) == [brute(d) for d in docs]


def test_equals_brute_force_on_sparse_marks():
    """Long periods whose grams are nearly all periodic themselves: one odd word in a plain row."""
    docs = [(["a"] * (p - 1) + ["b"]) * 4 + ["a"] * t for p in (24, 31, 32, 33, 63, 64, 65, 127, 200, 511) for t in (0, 1, 40, 300)]
    docs += [(["a", "b"] * p + ["a"]) * 3 for p in (16, 40, 65, 128)] + [["a"] * 5000, list("ab") * 3000, ["x"] * 23, ["x"] * 24]
    fib, prev = list("ab"), list("a")
    while len(fib) < 3000:
        fib, prev = fib + prev, fib
    docs.append(fib)
    docs.append([format(i, "b").count("1") % 2 for i in range(4096)])
    assert found(docs) == [brute(d) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=260), max_size=5), st.integers(1, 5))
def test_equals_brute_force(docs, times):
    docs = [d * times for d in docs]
    assert found(docs) == [brute(d) for d in docs]


def expected(key, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, sf_small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = op12_periodic_runs(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == expected(r.doc_id, docs[r.doc_id]), r.doc_id
    assert sum(r.n_runs > 0 for r in out) > 10


def test_query_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, unusual spaces and a long text, read from a table like any other."""
    ten = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(1, None), (1, ""), (2, " \t\n"), (3, "a b\x1cc\x85d " * 30), (3, "a b\x1cc\x85d " * 30), (5, "x y " * 100_000)]
    rows += [(ten[0], None), (ten[1], ""), (ten[2], "one"), (ten[3], "é ß\n" * 9 + "z"), *[(k, f"{k} a b c d e f g " * 40) for k in ten[4:20]]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in op12_periodic_runs(spark, str(tmp_path)).collect())
    assert [r for r in out if r[0] != 5] == sorted((k, *expected(k, t)) for k, t in rows if k != 5)
    assert [r[1:6] for r in out if r[0] == 5] == [(1, 0, 200_000, 2, 100_000_000)]


def test_odd_tables(spark):
    rows = [(None, None, "x"), (None, "a " * 30, "y"), (1, "", None), (1, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, RUNS string")
    out = find_runs(docs).collect()
    assert find_runs(docs).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out] == [(0, [], ""), (30, [(0, 30, 1)], "a"), (0, [], ""), (0, [], "")]
    assert find_runs(docs.limit(0)).collect() == []
