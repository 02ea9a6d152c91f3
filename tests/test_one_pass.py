"""The one crossing into Python: against the row-by-row kernels, with odd rows, several predictors and their memory."""

import pytest
from pyspark.sql import functions as F

from tremor.functions import kernels as K
from tremor.functions import text as T
from tremor.operators import metrics as M
from tremor.operators import one_pass as OP
from tremor.operators import pairs as PR
from tremor.operators.perturb import make_perturber
from tremor.plans import experiment as X
from tremor.plans import stored
from tremor.plans import views as V

GRID = [("char_delete", 0.2), ("char_swap", 0.4), ("vowel_drop", 0.3), ("codemix", 0.5), ("paraphrase", 0.5), ("delete+swap", 0.3)]
SCHEMA = "id string, language string, task string, split string, text string, premise string, hypothesis string, label string"
ROWS = [("1", "en", "t", "s", "The  quick ﬁne fox, of the world. ", None, None, "1"), ("2", "de", "t", "s", "", None, None, "0"),
        ("3", None, "t", "s", None, "A premise", "and a\u0085hypothesis the", "-1"), (None, "fr", "t", "s", "le monde �", None, None, None),
        ("5", "xx", "t", "s", None, None, None, "1"), ("6", "en", "t", "s", "the " * 3000, None, None, "1")]


def shouter():
    """Factory of a user's model: a dict, a tuple or a bare label, by length (nested: workers cannot import tests)."""
    def factory():
        def shout(texts):
            return [{"label": "long", "score": len(t) / 1e6} if len(t) > 20 else ("short", 0.5) if t else "none" for t in texts]
        return shout
    return factory


shout = shouter()()


def expected(row):
    p, out = make_perturber(), []
    i, lang = row[0], row[1]
    fields = {c: None if v is None else K.normalized(v) for c, v in zip(("text", "premise", "hypothesis"), row[4:7], strict=True)}
    for g, (pert, lv) in enumerate([("clean", 0.0), *GRID]):
        got = {c: None if v is None else p.apply(v, i, lang, pert, lv, c) for c, v in fields.items()}
        t = K.join_fields(got["premise"], got["hypothesis"], got["text"])
        n, h = K.stopword_stats(t, frozenset(OP.RuleModels(()).words))
        rule = [("1", h / n) if h / n >= th else ("0", 1 - h / n) for th in (0.2, 0.3)]
        out += [(g, m, *cell) for m, cell in enumerate([*rule, OP.unpacked(shout([t])[0])])]
    return out


def _predictors():
    return [OP.RuleModels((("a", 0.2), ("b", 0.3))), OP.Predictor("shout", shouter(), batch_size=3)]


def test_cells_equal_the_row_by_row_kernels(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.id: [tuple(c) for c in r.cells] for r in OP.crossed(df, GRID, _predictors()).collect()}
    for row in ROWS:
        assert got[row[0]] == expected(row), row[0]


def test_slices_and_partitions_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame(ROWS * 3, SCHEMA)
    a = sorted(map(str, OP.crossed(df.coalesce(1), GRID, _predictors(), with_text=True).collect()))
    b = sorted(map(str, OP.crossed(df.repartition(5), GRID, _predictors(), with_text=True).collect()))
    assert a == b
    batch = _arrow(ROWS)
    whole = OP._one_slice(batch, [OP.CLEAN, *GRID], make_perturber(), [p.load() for p in _predictors()], [2, 1], ("id",), True, True).to_pylist()
    monkeypatch.setattr(OP, "SLICE_CHARS", 1)
    parts = list(OP._slices(batch, 7))
    assert len(parts) > 3
    cut = [r for s in parts for r in OP._one_slice(s, [OP.CLEAN, *GRID], make_perturber(), [p.load() for p in _predictors()], [2, 1], ("id",), True, True).to_pylist()]
    assert cut == whole


def _arrow(rows):
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


def test_normalizing_equals_the_column_form(spark):
    texts = ["a b　c\u0085d\u001ce\u000bf​g", "ﬁ Ａ�", None, "  x \t\n ", "é é", "\x00\x07 a"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize("t")).collect()]
    assert got == [K.normalized(t) for t in texts]


def test_paired_and_long_rows_say_the_same(spark):
    x = OP.crossed(spark.createDataFrame([r for r in ROWS if r[0]], SCHEMA), GRID, _predictors())
    ps = _predictors()
    cols = ["model", "perturbation", "level", "id", "pred_clean", "score_clean", "pred_pert", "score_pert"]
    a = sorted(map(str, OP.paired_rows(x, GRID, ps).select(*cols).collect()))
    runs = OP.long_rows(x, GRID, ps).fillna("unknown", ["language"])
    pj = PR.pair_join(runs).select("model", "perturbation", "level", "id", F.col("prediction_clean").alias("pred_clean"),
                                   F.col("score_clean"), F.col("prediction_pert").alias("pred_pert"), "score_pert")
    assert a == sorted(map(str, pj.collect())) and len(a) == 5 * 3 * len(GRID)


def test_no_examples_no_grid_no_predictor(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert OP.crossed(df.limit(0), GRID, _predictors()).collect() == []
    assert OP.paired_rows(OP.crossed(df, [], _predictors()), [], _predictors()).collect() == []
    bare = OP.crossed(df, GRID, with_text=True).collect()
    assert all(r.cells == [] and len(r.texts) == 1 + len(GRID) for r in bare)


def test_wrong_number_of_outputs_fails(spark):
    bad = [OP.Predictor("bad", lambda: lambda texts: ["x"])]
    with pytest.raises(Exception, match="1 outputs for"):
        OP.crossed(spark.createDataFrame(ROWS, SCHEMA), GRID, bad).collect()


def test_loaded_predictors_are_few_and_closed(monkeypatch):
    monkeypatch.setattr(OP, "_kept", OP.OrderedDict())
    opened, closed = [], []

    def factory(name):
        def load():
            opened.append(name)

            def predict(texts):
                return ["x"] * len(texts)
            predict.close = lambda: closed.append(name)
            return predict
        return load

    models = [OP.Predictor(str(i), factory(i)) for i in range(OP.KEPT + 2)]
    for m in models:
        OP.loaded(m)
        OP.loaded(m)
    assert opened == list(range(OP.KEPT + 2)) and closed == [0, 1] and len(OP._kept) == OP.KEPT
    OP.loaded(models[0])
    assert opened[-1] == 0 and closed == [0, 1, 2]


def test_configuration(spark):
    df = spark.createDataFrame([(str(i), lg, "t", "s", f"the {i} of word", None, None, "1") for i in range(9) for lg in ("en", "de", None)], SCHEMA)
    df = df.withColumn("id", F.concat("id", F.coalesce("language", F.lit("-"))))
    config = {"tasks": [{"name": "t"}], "models": [{"name": "a"}], "perturbations": [{"type": "clean"}, {"type": "char_swap"}],
              "languages": ["en", "unknown"], "limit_samples": 4}
    load = lambda s, name, kind: df.withColumn("task", F.lit(name))
    out = X.configured(spark, config, load, {"a": OP.Predictor("a", shouter())}).collect()
    assert sum(r.n for r in out) == 4 and {(r.perturbation, r.level) for r in out} == {("char_swap", 0.1)}
    with pytest.raises(ValueError, match="no predictor"):
        X.configured(spark, config, load, {})


def _runs(spark, rows):
    return spark.createDataFrame(rows, "model string, task string, perturbation string, level double, language string, "
                                       "id string, label string, prediction string, score double")


def test_pairing_equals_a_join_in_plain_python(spark):
    import random

    r = random.Random(4)
    rows = [("m", "t", p, lv, "en", str(i), "1", r.choice(["0", "1", None]), 0.5) for i in range(60)
            for p, lv in (("clean", 0.0), ("a", 0.1), ("a", 0.2), ("b", 0.1)) if r.random() < 0.7]
    rows += [("m", "t", "a", 0.1, "fr", "x", "1", "0", 0.5), ("m", "u", "clean", 0.0, "en", "1", "1", "0", 0.5), ("m", "u", "a", 0.1, "en", "2", "1", "0", 0.5)]
    rows += [("m", "t", "clean", 0.0, "en", None, "1", "1", 0.5)] * 3 + [("m", "t", "a", 0.1, "en", None, "1", "1", 0.5)] * 2
    df = _runs(spark, rows)
    clean = {x[:2] + x[4:6]: x for x in rows if x[2] == "clean" and x[5] is not None}
    pairs = [(x, clean[x[:2] + x[4:6]]) for x in rows if x[2] != "clean" and x[:2] + x[4:6] in clean]
    got = sorted((q.id, q.perturbation, q.level, str(q.prediction_clean), str(q.prediction_pert)) for q in PR.pair_join(df).collect())
    assert got == sorted((x[5], x[2], x[3], str(c[7]), str(x[7])) for x, c in pairs)
    out = {(q.task, q.language, q.perturbation, q.level): q for q in PR.comparison_counts(df).collect()}
    groups = {(x[1], x[4]) for x in rows if x[2] == "clean"}
    assert set(out) == {(x[1], x[4], x[2], x[3]) for x in rows if x[2] != "clean" and (x[1], x[4]) in groups}
    for key, q in out.items():
        own = [(x, c) for x, c in pairs if (x[1], x[4], x[2], x[3]) == key]
        ids = {x[5] for x in rows if (x[1], x[4]) == key[:2] and x[2] == "clean" and x[5] is not None}
        every = [x for x in rows if (x[1], x[4], x[2], x[3]) == key]
        assert (q.n_matched, q.n_clean_only, q.n_pert_only) == (len(own), len(ids) - len(own), len(every) - len(own))
        assert q.n_same == sum(c[7] is not None and c[7] == x[7] for x, c in own) and q.n_agree == sum(c[7] == x[7] for x, c in own)
    stats = M.stats_from_counts(PR.comparison_counts(df)).filter("task = 'u'").collect()
    assert [(s.total_samples, s.consistency, s.flip_rate) for s in stats] == [(0, 0.0, 0.0)]
    assert {tuple(x) for x in PR.run_pairs(df).collect()} == {("m", *k[:2], *k[2:]) for k in out}


def test_duplicates_fail_in_the_summaries_too(spark):
    rows = [("m", "t", "clean", 0.0, "en", "1", "1", "1", 0.9)] + [("m", "t", "a", 0.1, "en", "1", "1", "1", 0.9)] * 2
    with pytest.raises(Exception, match="duplicate id"):
        PR.comparison_counts(_runs(spark, rows)).collect()
    assert [tuple(r)[5:] for r in PR.coverage(_runs(spark, rows)).collect()] == [(1, 0, 0)]


def test_matrix_with_nulls_and_many_classes(spark):
    import random

    r = random.Random(2)
    classes = [None, *"abcdefg"]
    rows = [("g", r.choice(classes), r.choice(classes)) for _ in range(300)] + [("h", "a", "a")]
    out = {x.g: x for x in M.all_metrics(spark.createDataFrame(rows, "g string, label string, prediction string"), ["g"]).collect()}
    mine = [x[1:] for x in rows if x[0] == "g"]
    assert {(c.true_label, c.pred_label): c.n for c in out["g"].cells} == {(t, p): mine.count((t, p)) for t in classes for p in classes}
    f1 = [2 * mine.count((k, k)) / (sum(t == k for t, _ in mine) + sum(p == k for _, p in mine)) for k in classes]
    assert out["g"].f1_macro == pytest.approx(sum(f1) / len(f1)) and out["g"].accuracy == pytest.approx(sum(t == p for t, p in mine) / 300)
    assert (out["h"].accuracy, out["h"].f1_macro, out["h"].n) == (1.0, 1.0, 1)
    assert M.with_matrix(M.all_metrics(spark.createDataFrame(rows, "g string, label string, prediction string"), ["g"]), ["g"]).filter("g = 'h'").first().confusion_matrix == "[[1]]"


def test_stored_table_follows_its_input(spark, tmp_path, sf_small):
    """A changed input is stored anew, and what was stored before is removed."""
    import os
    import shutil

    for t in stored.SOURCES:
        shutil.copy(f"{sf_small}/{t}.parquet", tmp_path / f"{t}.parquet")
    path = str(tmp_path)
    first = stored.stored_examples(spark, path)
    n = first.count()
    folder = stored._examples[(spark.sparkContext.applicationId, path)][2]
    assert os.path.isdir(folder) and stored.stored_examples(spark, path).count() == n
    spark.read.parquet(f"{sf_small}/benchmark.parquet").limit(3).toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert stored.stored_examples(spark, path).filter("task = 'benchmark'").count() == 3
    assert not os.path.isdir(folder)
    stored.forget(spark, path)
    assert (spark.sparkContext.applicationId, path) not in stored._examples


def test_grid_table_and_limits(spark):
    assert OP.grid_rows(V.grid(spark, [("char_swap", [0.1, 0.1]), ("clean", [])], include_clean=True)) == [("char_swap", 0.1)]
    with pytest.raises(ValueError, match="more than"):
        OP.grid_rows(spark.range(OP.BROADCAST_ROWS + 1).selectExpr("'a' as perturbation", "double(id) as level"))
