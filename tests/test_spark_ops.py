"""Spark-side operators on hand-written rows: normalization, input formatting, metrics, null rules, RNG parity."""

import pytest
from pyspark.sql import functions as F

from tremor.functions import rng
from tremor.functions import text as T
from tremor.operators import metrics as M
from tremor.operators import pairs as PR
from tremor.operators import perturb as P
from tremor.operators import reports as RP


def test_whitespace_and_nfkc(spark):
    rows = [("a b　c\u0085d\u001ce\u000bf​g",), ("ﬁ Ａ�",), (None,), ("  x  ",)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.normalize("t")).collect()]
    assert out == ["a b c d e f​g", "fi A", "", "x"]


def test_truncate_and_format(spark):
    df = spark.createDataFrame([("x" * 101, None, None), (None, "p", "h")], "text string, premise string, hypothesis string")
    out = df.select(T.format_truncate().alias("v"), T.format_input().alias("w")).collect()
    assert len(out[0].v) == 100 and out[1].v == "p h" and out[1].w == "p h"


def test_rng_spark_equals_python(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    k = rng.row_key(42, "text:char_delete", "id")
    got = df.select("id", k.alias("k"), rng.draw(k, 7).alias("d")).collect()
    for r in got:
        assert r.k == rng.py_row_key(42, "text:char_delete", r.id)
        assert r.d == int(rng.np_draws(r.k, 8)[7])


def test_macro_f1_one_sided_classes(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("g", "b", "b"), ("g", "c", "b"), ("g", "b", "d")],
                               "g string, label string, prediction string")
    r = M.classification_metrics(df, ["g"]).collect()[0]
    assert r.accuracy == pytest.approx(0.4)
    assert r.f1_macro == pytest.approx(0.266667, abs=1e-6)
    conf = M.confusion(df, ["g"]).collect()
    assert len(conf) == 16 and sum(c.n for c in conf if c.true_label == c.pred_label) == 2


def test_null_prediction_rules(spark):
    df = spark.createDataFrame([("g", None, None), ("g", "a", "a")],
                               "g string, prediction_clean string, prediction_pert string")
    stats = M.flip_stats(df, ["g"]).collect()[0]
    assert stats.flipped_count == 1 and stats.consistency + stats.flip_rate == pytest.approx(1.0)
    cons = M.consistency(df, ["g"], "prediction_clean", "prediction_pert").collect()[0]
    assert cons.consistency == pytest.approx(1.0)


def test_relative_drop_zero_clean(spark):
    c = spark.createDataFrame([("en", 0.0, 0.0)], "language string, accuracy double, f1_macro double")
    p = spark.createDataFrame([("en", 0.0, 0.0), ("hi", 0.5, 0.5)], "language string, accuracy double, f1_macro double")
    out = {r.language: r for r in M.outer_summary(c, p, ["language"]).collect()}
    assert out["en"].rel_drop_acc == 0.0 and out["hi"].acc_clean == 0.0 and out["hi"].rel_drop_acc == 0.0


def _runs(spark, rows):
    return spark.createDataFrame(rows, "model string, task string, perturbation string, level double, language string, "
                                       "id string, text string, label string, prediction string, score double")


def test_duplicate_ids_fail(spark):
    rows = [("m", "t", "clean", 0.0, "en", "-1", "x", "1", "1", 0.9),
            ("m", "t", "clean", 0.0, "en", "-1", "y", "1", "0", 0.9),
            ("m", "t", "char_swap", 0.1, "en", "-1", "x", "1", "1", 0.9)]
    with pytest.raises(Exception, match="duplicate id"):
        PR.pair_join(_runs(spark, rows)).collect()


def test_coverage_reports_unmatched(spark):
    rows = [("m", "t", "clean", 0.0, "en", "1", "x", "1", "1", 0.9),
            ("m", "t", "clean", 0.0, "en", "2", "x", "1", "1", 0.9),
            ("m", "t", "char_swap", 0.1, "en", "1", "x", "1", "0", 0.95),
            ("m", "t", "char_swap", 0.1, "en", "3", "x", "1", "0", 0.95)]
    r = PR.coverage(_runs(spark, rows)).collect()[0]
    assert (r.n_matched, r.n_clean_only, r.n_pert_only) == (1, 1, 1)
    errs = RP.error_cases(PR.pair_join(_runs(spark, rows))).collect()
    assert {e.type for e in errs} == {"prediction_flip", "high_confidence_failure"}


def test_partition_invariance(spark, sf_small):
    from tremor.plans import views as V

    base = V.examples(spark, sf_small)
    g = V.grid(spark)
    p = P.make_perturber()

    def run(df):
        return sorted(P.perturb(df, g, text_cols=("text",), perturber=p)
                      .select("id", "perturbation", "level", "text").collect())

    assert run(base.repartition(1)) == run(base.repartition(7))


def test_bootstrap_weights_poisson(spark):
    ths = RP.poisson_thresholds()
    assert ths == sorted(ths) and ths[0] == int(0.36787944117144233 * rng.P)


def test_outer_metrics_missing_sides(spark):
    met = spark.createDataFrame(
        [("m", "t", "clean", 0.0, "en", 0.8, 0.7), ("m", "t", "clean", 0.0, "hi", 0.6, 0.5),
         ("m", "t", "char_swap", 0.1, "en", 0.4, 0.3), ("m", "t", "char_swap", 0.1, "bn", 0.2, 0.1),
         ("m", "t", "codemix", 0.5, "hi", 0.3, 0.3)],
        "model string, task string, perturbation string, level double, language string, accuracy double, "
        "f1_macro double")
    got = {(r.perturbation, r.language): (r.acc_clean, r.acc_perturbed)
           for r in M.outer_metrics(met).collect()}
    assert got == {("char_swap", "en"): (0.8, 0.4), ("char_swap", "hi"): (0.6, 0.0),
                   ("char_swap", "bn"): (0.0, 0.2), ("codemix", "en"): (0.8, 0.0),
                   ("codemix", "hi"): (0.6, 0.3)}


def test_comparison_without_overlap_reports_zeros(spark):
    rows = [("m", "t", "clean", 0.0, "en", "1", "x", "1", "1", 0.9),
            ("m", "t", "char_swap", 0.1, "en", "2", "x", "1", "0", 0.9)]
    r = _runs(spark, rows)
    st = M.flip_stats(PR.pair_join(r), RP.GROUP, comparisons=PR.run_pairs(r)).collect()[0]
    assert (st.total_samples, st.consistency, st.flip_rate) == (0, 0.0, 0.0)
    fc = RP.flip_counts(PR.pair_join(r), comparisons=PR.run_pairs(r)).collect()[0]
    assert (fc.total_samples, fc.flip_count, fc.flip_rate) == (0, 0, 0.0)


def test_unlabelled_rows_default_and_drop(spark, sf_small):
    from tremor.sources import tables

    kept = tables.scan_task(spark, sf_small, "benchmark")
    assert kept.count() > 0 and kept.filter("label = '-1' AND language = 'unknown'").count() == kept.count()
    assert tables.scan_task(spark, sf_small, "benchmark", drop_unlabeled=True).count() == 0


def test_ascii_texts_do_not_cross_into_python(spark, monkeypatch):
    import pandas as pd

    @F.pandas_udf("string")
    def marked(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "crossed " + t)

    monkeypatch.setattr(T, "nfkc", marked)
    rows = ["plain text", "", None, "d\u00e9j\u00e0", "\ufb01ne", "e\u0301", "\u00aa", "\u4e00"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(T.normalize("t")).collect()]
    assert got == ["plain text", "", "", *["crossed " + t for t in rows[3:]]]
