"""Naive Bayes by aggregates against the same formula in plain Python."""

import math
from collections import Counter

import pytest

from tremor.operators import score as S
from tremor.session import scratch_path

TRAIN = [("1", "a a b", "x"), ("2", "b c", "y"), ("3", "A  d", "x"), ("4", None, "y"), ("5", "e", None), ("6", "", "y")]
TEST = [("7", "a b b zz"), ("8", ""), ("9", None), ("10", "c " * 500), ("11", "zz")]


def expected(text):
    rows = [(t or "", c) for _, t, c in TRAIN if c is not None]
    counts = {c: Counter(w for t, k in rows if k == c for w in t.lower().split(" ") if w) for c in "xy"}
    vocabulary = {w for c in counts.values() for w in c}
    s = {c: math.log(sum(k == c for _, k in rows) / len(rows)) + sum(
        math.log((counts[c][w] + 1) / (counts[c].total() + len(vocabulary))) for w in (text or "").lower().split(" ") if w) for c in "xy"}
    best = max(sorted(s), key=s.get)
    return best, 1 / sum(math.exp(v - s[best]) for v in s.values())


def _model(spark):
    return S.fit_naive_bayes(spark.createDataFrame(TRAIN, "id string, input string, label string"), scratch_path(spark, "nb"))


def test_equals_the_formula(spark):
    out = {r.id: r for r in S.score_naive_bayes(spark.createDataFrame(TEST, "id string, input string"), _model(spark)).collect()}
    for i, t in TEST:
        label, score = expected(t)
        assert out[i].prediction == label and out[i].score == pytest.approx(score)
    assert out["8"].model == "naive-bayes" and out["8"].input == "" and len(out) == len(TEST)


def test_one_class_none_and_no_rows(spark):
    one = spark.createDataFrame([("1", "a", "x")], "id string, input string, label string")
    model = S.fit_naive_bayes(one, scratch_path(spark, "nb"))
    test = spark.createDataFrame(TEST, "id string, input string")
    assert {(r.prediction, r.score) for r in S.score_naive_bayes(test, model).collect()} == {("x", 1.0)}
    assert S.score_naive_bayes(test.limit(0), model).collect() == []
    with pytest.raises(ValueError, match="classes"):
        S.fit_naive_bayes(one.limit(0), scratch_path(spark, "nb"))
