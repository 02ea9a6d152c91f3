import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm.hilbert_search import hilbert_keys, nearest
from tremor.llm.queries import op3_hilbert_search


@pytest.mark.parametrize("d,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    order = cells[np.argsort(hilbert_keys(cells, bits))]
    assert len(set(hilbert_keys(cells, bits))) == len(cells)
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def brute(ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = {int(ids[j]): s[j] for j in order}
    return out


def test_query_recall_and_scores(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = brute(ids, x, 5), op3_hilbert_search(spark, sf_small).collect()
    assert sorted({r.query_id for r in got}) == sorted(want)
    assert all([r.rank for r in g] == [1, 2, 3, 4, 5] for _, g in itertools.groupby(sorted(got, key=lambda r: (r.query_id, r.rank)), lambda r: r.query_id))
    at = {int(i): n for n, i in enumerate(ids)}
    for r in got:
        a, b = x[at[r.query_id]], x[at[r.vec_id]]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert sum(r.vec_id in want[r.query_id] for r in got) / len(got) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (None, [1.0, 1.0]), (50, [0.0, 3.0]), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, key int")
    got = [tuple(r)[:3] for r in nearest(df, F.col("vec_id") % 50 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 9), (50, 1, 9), (50, 2, 0), (50, 3, 1)]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_components_of_any_size(spark):
    """Squares out of the range of doubles change no cosine; vectors of another length take no part."""
    rows = [(0, [1e200, 1e200]), (1, [0.0, 1.0]), (2, [2e-200, 2e-200]), (3, [1e200, 1e200]), (4, [-1.0, -1.0]), (5, [1.0]), (100, [1.0, 1.0, 1.0]), (6, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 6, 1.0), (0, 4, 1, round(0.5 ** 0.5, 9)), (0, 5, 4, -1.0)]
