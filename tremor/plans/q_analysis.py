"""Pairing, metrics, error analysis and roll-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import fixed, rng
from tremor.operators import metrics as M
from tremor.operators import pairs as PR
from tremor.operators import reports as RP
from tremor.operators import sampling
from tremor.operators import score as S
from tremor.plans import oracle as O
from tremor.plans import views as V
from tremor.plans.catalog import register, rounded
from tremor.plans.stored import stored_report, stored_runs, stored_texts
from tremor.sources import tables

RUN5 = ["model", "task", "perturbation", "level", "language"]
GROUP = RP.GROUP  # model, task, language, perturbation, level


def _runs_sql(body: str, extra: list[str] | None = None) -> str:
    return O.with_(O.runs_ctes() + (extra or []), body)


PJ = """pj AS (
  SELECT c.model, c.task, c.language, c.id, c.text AS text_clean, c.label AS label_clean,
         c.prediction AS prediction_clean, c.score AS score_clean, p.perturbation, p.level,
         p.text AS text_pert, p.label AS label_pert, p.prediction AS prediction_pert, p.score AS score_pert
  FROM runs c JOIN runs p ON c.model = p.model AND c.task = p.task AND c.language = p.language AND c.id = p.id
  WHERE c.perturbation = 'clean' AND p.perturbation <> 'clean')"""

_COVER_KEY = O.key_sql("'cover'", "id")
DIFF = "NOT coalesce({a} = {b}, false)"


def _r(cols):
    return ", ".join(O.r6(c, c.split(".")[-1]) for c in cols)


# ---- runs and pairing ---------------------------------------------------------------------

@register("runs_long", lambda: _runs_sql(
    "SELECT model, task, perturbation, level, language, id, text, label, prediction, round(score, 6) AS score FROM runs"))
def runs_long(spark, sf_dir):
    """Clean and perturbed predictions stacked in one long table (C9), read back from the written run table."""
    return rounded(stored_runs(spark, sf_dir))


@register("pair_runs", lambda: _runs_sql("""SELECT DISTINCT c.model, c.task, c.language, p.perturbation, p.level
  FROM (SELECT DISTINCT model, task, language FROM runs WHERE perturbation = 'clean') c
  JOIN (SELECT DISTINCT model, task, language, perturbation, level FROM runs WHERE perturbation <> 'clean') p
  USING (model, task, language)"""))
def pair_runs(spark, sf_dir):
    """Every perturbed run paired with the clean run of its (model, task, language)."""
    return PR.run_pairs(stored_runs(spark, sf_dir, text=False))


@register("pair_join", lambda: _runs_sql(
    "SELECT model, task, language, id, text_clean, label_clean, prediction_clean, round(score_clean, 6) AS score_clean, "
    "perturbation, level, text_pert, label_pert, prediction_pert, round(score_pert, 6) AS score_pert FROM pj", [PJ]))
def pair_join(spark, sf_dir):
    """Clean and perturbed rows of the same id side by side; duplicate ids fail the query (C4)."""
    texts = stored_texts(spark, sf_dir)
    narrow = PR.pair_join(stored_runs(spark, sf_dir, text=False))  # (of the same stored table)
    return rounded(PR.fetched(narrow, texts, every=True))


_DROPPED = "NOT (perturbation = 'clean' AND {u} % 7 = 0) AND NOT (perturbation <> 'clean' AND {u} % 5 = 0)"


@register("pair_coverage", lambda: _runs_sql("""SELECT p.model, p.task, p.language, p.perturbation, p.level,
    count(c.id) AS n_matched, any_value(g.n) - count(c.id) AS n_clean_only, count(*) - count(c.id) AS n_pert_only
  FROM (SELECT * FROM part WHERE perturbation <> 'clean') p
  LEFT JOIN (SELECT * FROM part WHERE perturbation = 'clean') c USING (model, task, language, id)
  JOIN (SELECT model, task, language, count(*) AS n FROM part WHERE perturbation = 'clean' GROUP BY ALL) g USING (model, task, language)
  GROUP BY ALL""", [f"part AS (SELECT * FROM runs WHERE {_DROPPED.format(u=_COVER_KEY)})"]))
def pair_coverage(spark, sf_dir):
    """Ids present on both sides, only clean, only perturbed, per comparison.

    The stored runs are complete, so both sides lose some ids here, by a draw on the id: a seventh of the clean
    rows and a fifth of the perturbed ones.
    """
    u = rng.row_key(fixed.DEFAULT_SEED, "cover", "id")
    clean = F.col("perturbation") == "clean"
    part = stored_runs(spark, sf_dir, text=False).filter(~(clean & (u % 7 == 0)) & ~(~clean & (u % 5 == 0)))
    return PR.coverage(part)


def _label_map_df(spark):
    rows = [(m, f"LABEL_{i}", str(i)) for m in ("stopword-t20", "stopword-t30") for i in (0, 1)]
    return PR.label_map_table(spark, rows)


@register("label_map", lambda: _runs_sql("""SELECT model, task, perturbation, level, language, id,
    'LABEL_' || prediction AS raw_prediction, prediction FROM runs"""))
def label_map(spark, sf_dir):
    """Model labels (LABEL_k, as pretrained classifiers emit them) mapped back to dataset labels."""
    r = stored_runs(spark, sf_dir, text=False).select(*RUN5, "id", F.concat(F.lit("LABEL_"), "prediction").alias("prediction"))
    r = r.withColumn("raw_prediction", F.col("prediction"))
    return PR.map_labels(r, _label_map_df(spark))


def _metrics_sql_ctes(src: str = "runs", keys=None) -> list[str]:
    keys = keys or RUN5
    k = ", ".join(keys)
    return [
        f"mcnt AS (SELECT {k}, label, prediction, count(*) AS n FROM {src} GROUP BY ALL)",
        O.f1_cte("mf1", "mcnt", keys, "label", "prediction", "f1_macro"),
        f"""macc AS (SELECT {k}, sum(CASE WHEN label IS NOT DISTINCT FROM prediction THEN n ELSE 0 END) / sum(n)
            AS accuracy, sum(n) AS n FROM mcnt GROUP BY ALL)""",
        f"met AS (SELECT * FROM macc JOIN mf1 USING ({k}))",
    ]


@register("accuracy", lambda: _runs_sql("SELECT model, task, perturbation, level, language, "
                                        "round(accuracy, 6) AS accuracy FROM met", _metrics_sql_ctes()))
def accuracy(spark, sf_dir):
    """Accuracy per run group (F1)."""
    r = stored_runs(spark, sf_dir, text=False)
    cnt = M.counts(r, RUN5, "label", "prediction")
    return rounded(M.accuracy_from_counts(cnt, RUN5, "label", "prediction"))


@register("f1_macro", lambda: _runs_sql("SELECT model, task, perturbation, level, language, "
                                        "round(f1_macro, 6) AS f1_macro FROM met", _metrics_sql_ctes()))
def f1_macro(spark, sf_dir):
    """Macro F1 over the union of true and predicted classes per run group (F2)."""
    r = stored_runs(spark, sf_dir, text=False)
    cnt = M.counts(r, RUN5, "label", "prediction")
    return rounded(M.f1_from_counts(cnt, RUN5, "label", "prediction"))


MATRIX_CTES = ["""classes AS (SELECT model, task, perturbation, level, language, list_sort(list(DISTINCT cls)) AS cl
  FROM (SELECT *, label AS cls FROM mcnt UNION ALL SELECT *, prediction FROM mcnt) GROUP BY ALL)""",
  """cells AS (SELECT c.model, c.task, c.perturbation, c.level, c.language, c.cl, t.i, p.j, CAST(coalesce(m.n, 0) AS BIGINT) AS n
  FROM classes c, LATERAL (SELECT unnest(range(1, len(c.cl) + 1)) AS i) t, LATERAL (SELECT unnest(range(1, len(c.cl) + 1)) AS j) p
  LEFT JOIN mcnt m ON m.model = c.model AND m.task = c.task AND m.perturbation = c.perturbation AND m.level = c.level
    AND m.language = c.language AND m.label = c.cl[t.i] AND m.prediction = c.cl[p.j])""",
  """matrix AS (SELECT model, task, perturbation, level, language, '["' || array_to_string(any_value(cl), '","') || '"]' AS classes,
    '[' || string_agg(line, ',' ORDER BY i) || ']' AS confusion_matrix
  FROM (SELECT model, task, perturbation, level, language, any_value(cl) AS cl, i, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY j) || ']' AS line
        FROM cells GROUP BY model, task, perturbation, level, language, i) GROUP BY model, task, perturbation, level, language)"""]
MATRIX_SQL = """SELECT model, task, perturbation, level, language, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
    CAST(n AS BIGINT) AS n, classes, confusion_matrix FROM met JOIN matrix USING (model, task, perturbation, level, language)"""


@register("evaluate_task", lambda: _runs_sql(MATRIX_SQL, _metrics_sql_ctes() + MATRIX_CTES))
def evaluate_task(spark, sf_dir):
    """Accuracy, macro F1 and confusion matrix of every task under every perturbation, per language."""
    return rounded(M.with_matrix(M.all_metrics(stored_runs(spark, sf_dir, text=False), RUN5), RUN5))


@register("confusion", lambda: _runs_sql(f"""SELECT c.model, c.task, c.perturbation, c.level, c.language,
    c.true_label, c.pred_label, CAST(coalesce(m.n, 0) AS BIGINT) AS n
  FROM (SELECT a.*, b.cls AS pred_label FROM (SELECT DISTINCT model, task, perturbation, level, language, cls AS true_label
          FROM (SELECT *, label AS cls FROM mcnt UNION ALL SELECT *, prediction FROM mcnt)) a
        JOIN (SELECT DISTINCT model, task, perturbation, level, language, cls
          FROM (SELECT *, label AS cls FROM mcnt UNION ALL SELECT *, prediction FROM mcnt)) b
        USING (model, task, perturbation, level, language)) c
  LEFT JOIN mcnt m ON m.model = c.model AND m.task = c.task AND m.perturbation = c.perturbation
    AND m.level = c.level AND m.language = c.language AND m.label = c.true_label AND m.prediction = c.pred_label""",
    _metrics_sql_ctes()))
def confusion(spark, sf_dir):
    """Zero-filled confusion counts over the sorted class union of each run group."""
    return M.confusion(stored_runs(spark, sf_dir, text=False), RUN5)


@register("consistency", lambda: O.with_(O.paired_ctes(), """SELECT model, task, perturbation, level, language,
    round(avg(CASE WHEN pred_clean IS NOT DISTINCT FROM pred_pert THEN 1.0 ELSE 0.0 END), 6) AS consistency,
    count(*) AS n_pairs FROM paired GROUP BY ALL"""))
def consistency(spark, sf_dir):
    """Share of unchanged predictions, clean vs perturbed (list rule: null == null agrees)."""
    return rounded(M.consistency(V.paired(spark, sf_dir), RUN5))


def _metrics_outer_ctes() -> list[str]:
    return _metrics_sql_ctes() + [
        """mo AS (
  SELECT coalesce(c.model, p.model) AS model, coalesce(c.task, p.task) AS task,
         coalesce(c.perturbation, p.perturbation) AS perturbation, coalesce(c.level, p.level) AS level,
         coalesce(c.language, p.language) AS language,
         coalesce(c.accuracy, 0.0) AS acc_clean, coalesce(c.f1_macro, 0.0) AS f1_clean,
         coalesce(p.accuracy, 0.0) AS acc_perturbed, coalesce(p.f1_macro, 0.0) AS f1_perturbed
  FROM (SELECT m.model, m.task, k.perturbation, k.level, m.language, m.accuracy, m.f1_macro
        FROM met m JOIN (SELECT DISTINCT model, task, perturbation, level FROM met WHERE perturbation <> 'clean') k
        USING (model, task) WHERE m.perturbation = 'clean') c
  FULL OUTER JOIN (SELECT * FROM met WHERE perturbation <> 'clean') p
    USING (model, task, perturbation, level, language))"""]


def _spark_outer(spark, sf_dir):
    r = stored_runs(spark, sf_dir, text=False)
    return r, M.outer_metrics(M.classification_metrics(r, RUN5))


@register("metrics_outer", lambda: _runs_sql(
    "SELECT model, task, perturbation, level, language, " + _r(["acc_clean", "f1_clean", "acc_perturbed",
                                                                 "f1_perturbed"]) + " FROM mo",
    _metrics_outer_ctes()))
def metrics_outer(spark, sf_dir):
    """Clean and perturbed metrics over the union of their language keys; a missing side is 0.0."""
    _, j = _spark_outer(spark, sf_dir)
    return rounded(j.select(*RUN5, "acc_clean", "f1_clean", "acc_perturbed", "f1_perturbed"))


@register("robustness_summary", lambda: _runs_sql(
    "SELECT mo.model, mo.task, mo.perturbation, mo.level, mo.language, "
    + _r(["acc_clean", "acc_perturbed", "f1_clean", "f1_perturbed"]) + ", "
    + O.r6("acc_clean - acc_perturbed", "abs_drop_acc") + ", " + O.r6(O.rel("acc_clean", "acc_perturbed"), "rel_drop_acc")
    + ", " + O.r6("f1_clean - f1_perturbed", "abs_drop_f1") + ", " + O.r6(O.rel("f1_clean", "f1_perturbed"), "rel_drop_f1")
    + ", round(cs.consistency, 6) AS consistency FROM mo LEFT JOIN (SELECT model, task, perturbation, level, language, "
    "avg(CASE WHEN prediction_clean IS NOT DISTINCT FROM prediction_pert THEN 1.0 ELSE 0.0 END) AS consistency "
    "FROM pj GROUP BY ALL) cs USING (model, task, perturbation, level, language)",
    _metrics_outer_ctes() + [PJ]))
def robustness_summary(spark, sf_dir):
    """Robustness summary from stored predictions: metrics over the union of languages plus id-joined
    consistency (F5)."""
    out = RP.report_from_runs(stored_runs(spark, sf_dir, text=False))
    return rounded(out.select(*RUN5, "acc_clean", "acc_perturbed", "f1_clean", "f1_perturbed", "abs_drop_acc",
                              "rel_drop_acc", "abs_drop_f1", "rel_drop_f1", "consistency"))


# ---- filters and grid -------------------------------------------------------------------------

FILTER_LANGS = ["en", "de", "unknown"]


@register("filter_lang", lambda: O.with_([O.examples_cte(), O.pairs_cte(), O.tasks_cte()],
                                         f"SELECT id, task, language FROM tasks WHERE coalesce(language, 'unknown') "
                                         f"IN ({', '.join(O.q(x) for x in FILTER_LANGS)})"))
def filter_lang(spark, sf_dir):
    """Examples of the configured languages; a missing language counts as 'unknown' (C1)."""
    t = V.task_examples(spark, sf_dir)
    return t.filter(F.coalesce("language", F.lit("unknown")).isin(FILTER_LANGS)).select("id", "task", "language")


@register("filter_noise", lambda: _runs_sql("SELECT model, task, perturbation, level, language, id, prediction "
                                            "FROM runs WHERE level > 0 AND perturbation <> 'clean'"))
def filter_noise(spark, sf_dir):
    """Noisy runs only: level > 0 and perturbation != 'clean'; neither texts nor clean predictions are exploded."""
    r = stored_runs(spark, sf_dir, text=False)
    return r.filter((F.col("level") > 0) & (F.col("perturbation") != "clean")).select(*RUN5, "id", "prediction")


@register("grid_expand", lambda: O.with_(
    [O.examples_cte(), O.pairs_cte(), O.tasks_cte(), O.models_values(), O.grid_values()],
    """SELECT t.task, m.model, g.perturbation, g.level, t.n_examples
       FROM (SELECT task, count(*) AS n_examples FROM tasks GROUP BY task) t CROSS JOIN models m CROSS JOIN grid g
       UNION ALL SELECT t.task, m.model, 'clean', 0.0, t.n_examples
       FROM (SELECT task, count(*) AS n_examples FROM tasks GROUP BY task) t CROSS JOIN models m"""))
def grid_expand(spark, sf_dir):
    """Tasks x models x (perturbation, level), clean once at level 0, with each task's example count."""
    t = V.task_examples(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n_examples"))
    g = V.grid(spark, include_clean=True)
    m = S.default_models(spark).select("model")
    return t.crossJoin(m).crossJoin(g).select(
        "task", "model", "perturbation", "level", "n_examples")


# ---- windows: limits, splits, samples ------------------------------------------------------------

LIMIT_N = 5


@register("limit_samples", lambda: O.with_([O.examples_cte(), O.pairs_cte(), O.tasks_cte()],
                                           f"SELECT id, task, language, label FROM tasks QUALIFY row_number() OVER "
                                           f"(PARTITION BY task ORDER BY id) <= {LIMIT_N}"))
def limit_samples(spark, sf_dir):
    """First N examples per task by id (the configured sample limit)."""
    return sampling.limit_per_task(V.task_examples(spark, sf_dir), LIMIT_N).select("id", "task", "language", "label")


def _split_key():
    return O.key_sql("'split'", "id")


@register("split_hash", lambda: O.with_([O.examples_cte()], f"""SELECT id, task,
    CASE WHEN u < {O.thr(str(fixed.VALIDATION_FRACTION))} THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {O.draw_cols(_split_key(), '0')} FROM examples)"""))
def split_hash(spark, sf_dir):
    """Seeded 10 % validation split by hash threshold, no shuffle."""
    return sampling.split_hash(V.examples(spark, sf_dir)).select("id", "task", "split")


@register("split_exact", lambda: O.with_([O.examples_cte()], f"""SELECT id, task,
    CASE WHEN row_number() OVER (PARTITION BY task ORDER BY u, id)
              <= ceil({fixed.VALIDATION_FRACTION} * count(*) OVER (PARTITION BY task)) THEN 'validation'
         ELSE 'train' END AS split
  FROM (SELECT *, {O.draw_cols(_split_key(), '0')} FROM examples)"""))
def split_exact(spark, sf_dir):
    """Exactly ceil(10 % of N) validation rows per task, smallest draws first (W2, exact variant)."""
    return sampling.split_exact(V.examples(spark, sf_dir).select("id", "task"))


_BARE_KEY = "md5('=unknown' || chr(31) || '=bare' || chr(31) || '=train' || chr(31) || '=' || text || chr(31) || '-' || chr(31) || '-' || chr(31) || '=-1')"


@register("row_keys", lambda: f"""SELECT id, task, CASE WHEN u < {O.thr(str(fixed.VALIDATION_FRACTION))} THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {O.draw_cols(_split_key(), '0')} FROM (
    SELECT 'row-' || {_BARE_KEY} || '-' || (row_number() OVER (PARTITION BY text) - 1) AS id, 'bare' AS task FROM documents))""")
def row_keys(spark, sf_dir):
    """A table of bare texts, without ids: every row gets a stable key of its own and a split by it."""
    bare = tables.table(spark, sf_dir, "documents").select("text")
    return sampling.split_hash(tables.standardize(bare, "bare", row_keys=True)).select("id", "task", "split")


def _flip_cols_sql():
    return ("model, task, language, perturbation, level, id, prediction_clean, prediction_pert")


@register("topk_errors", lambda: _runs_sql(f"""SELECT {_flip_cols_sql()} FROM pj
  WHERE {DIFF.format(a='prediction_clean', b='prediction_pert')}
  QUALIFY row_number() OVER (PARTITION BY model, task, language, perturbation, level ORDER BY id) <= 5""", [PJ]))
def topk_errors(spark, sf_dir):
    """First five flips per run group, by id."""
    f = RP.flips(PR.pair_join(stored_runs(spark, sf_dir, text=False)))
    return sampling.first_per_group(f, GROUP, [F.col("id")], 5).select(*GROUP, "id", "prediction_clean",
                                                                       "prediction_pert")


def _sample_sql() -> str:
    k = O.key_sql("'sample'", "id")
    return f"""SELECT model, task, language, perturbation, level, id, label_clean AS label,
    prediction_clean AS clean_pred, prediction_pert AS pert_pred
  FROM (SELECT *, {O.draw_cols(k, '0')} FROM pj WHERE {DIFF.format(a='prediction_clean', b='prediction_pert')})
  QUALIFY row_number() OVER (PARTITION BY model, task, language, perturbation, level ORDER BY u, id) <= 5"""


@register("sample_flips", lambda: _runs_sql(_sample_sql(), [PJ]))
def sample_flips(spark, sf_dir):
    """Seeded sample of min(5, #flips) flips per run group."""
    return RP.sampled_flips(PR.pair_join(stored_runs(spark, sf_dir, text=False)))


@register("flip_report", lambda: _runs_sql(f"""SELECT k.model, k.task, k.language, k.perturbation, k.level,
    coalesce(s.total_samples, 0) AS total_samples, coalesce(s.flip_count, 0) AS flip_count,
    coalesce(round(s.flip_count / s.total_samples, 6), 0.0) AS flip_rate,
    least(coalesce(s.flip_count, 0), 5) AS n_sampled
  FROM cmp k LEFT JOIN (SELECT model, task, language, perturbation, level, count(*) AS total_samples,
    count_if({DIFF.format(a='prediction_clean', b='prediction_pert')}) AS flip_count FROM pj GROUP BY ALL) s
  USING (model, task, language, perturbation, level)""", [PJ, CMP]))
def flip_report(spark, sf_dir):
    """Flip counts and rate per run group, with the number of sampled flips reported."""
    st = M.stats_from_counts(PR.comparison_counts(stored_runs(spark, sf_dir, text=False)))
    return rounded(st.select(*GROUP, "total_samples", F.col("flipped_count").alias("flip_count"), "flip_rate",
                             F.least(F.col("flipped_count"), F.lit(5)).cast("bigint").alias("n_sampled")))


CMP = """cmp AS (SELECT DISTINCT c.model, c.task, c.language, p.perturbation, p.level
  FROM (SELECT DISTINCT model, task, language FROM runs WHERE perturbation = 'clean') c
  JOIN (SELECT DISTINCT model, task, language, perturbation, level FROM runs WHERE perturbation <> 'clean') p
  USING (model, task, language))"""


def _stats_sql(keys: str) -> str:
    """Flip statistics per comparison; a comparison without overlapping ids reports zeros."""
    same = "coalesce(prediction_clean = prediction_pert, false)"
    return f"""SELECT {keys}, coalesce(s.total_samples, 0) AS total_samples,
    coalesce(s.consistent_count, 0) AS consistent_count, coalesce(s.flipped_count, 0) AS flipped_count,
    coalesce(s.consistency, 0.0) AS consistency, coalesce(s.flip_rate, 0.0) AS flip_rate
  FROM (SELECT DISTINCT {keys} FROM cmp) LEFT JOIN (
    SELECT {keys}, count(*) AS total_samples, count_if({same}) AS consistent_count,
      count_if(NOT {same}) AS flipped_count, round(count_if({same}) / count(*), 6) AS consistency,
      round(1.0 - count_if({same}) / count(*), 6) AS flip_rate FROM pj GROUP BY ALL) s USING ({keys})"""


@register("consistency_stats", lambda: _runs_sql(_stats_sql("model, task, language, perturbation, level"), [PJ, CMP]))
def consistency_stats(spark, sf_dir):
    """total, consistent, flipped, consistency, flip rate per clean/perturbed file pair."""
    return rounded(M.stats_from_counts(PR.comparison_counts(stored_runs(spark, sf_dir, text=False))))


@register("consistency_all", lambda: _runs_sql(_stats_sql("task, language, perturbation"), [PJ, CMP]))
def consistency_all(spark, sf_dir):
    """Batch consistency over every (task, language, perturbation), all models and levels pooled."""
    return rounded(M.stats_from_counts(PR.comparison_counts(stored_runs(spark, sf_dir, text=False)), ["task", "language", "perturbation"]))


def _detail_body() -> str:
    return """SELECT model, task, language, perturbation, level, id,
    label_clean AS label, prediction_clean, prediction_pert,
    coalesce(prediction_clean = prediction_pert, false) AS is_consistent FROM pj"""


@register("consistency_detail", lambda: _runs_sql(_detail_body(), [PJ]))
def consistency_detail(spark, sf_dir):
    """Every compared example with both predictions and its consistency flag (F8)."""
    pj = PR.pair_join(stored_runs(spark, sf_dir, text=False))
    return pj.select(*GROUP, "id", F.col("label_clean").alias("label"), "prediction_clean", "prediction_pert",
                     F.coalesce(F.col("prediction_clean") == F.col("prediction_pert"), F.lit(False))
                     .alias("is_consistent"))


def _errors_sql() -> str:
    diff = DIFF.format(a="prediction_clean", b="prediction_pert")
    hc = DIFF.format(a="prediction_pert", b="label_pert") + f" AND score_pert > {fixed.HIGH_CONF_THRESHOLD}"
    part = "PARTITION BY model, task, language, perturbation, level ORDER BY id"
    return f"""SELECT 'prediction_flip' AS type, model, task, language, perturbation, level, id, text_clean,
    text_pert AS text_perturbed, prediction_clean AS pred_clean, prediction_pert AS pred_perturbed,
    label_clean AS ground_truth, CAST(NULL AS VARCHAR) AS prediction, CAST(NULL AS DOUBLE) AS confidence
  FROM pj WHERE {diff} QUALIFY row_number() OVER ({part}) <= 5
  UNION ALL
  SELECT 'high_confidence_failure', model, task, language, perturbation, level, id, NULL, text_pert, NULL, NULL,
    label_pert, prediction_pert, round(score_pert, 6)
  FROM pj WHERE {hc} QUALIFY row_number() OVER ({part}) <= 5"""


@register("error_cases", lambda: _runs_sql(_errors_sql(), [PJ]))
def error_cases(spark, sf_dir):
    """Five flips and five confident failures (score > 0.9) per run group, one heterogeneous table."""
    return rounded(RP.error_cases(PR.pair_join(stored_runs(spark, sf_dir)), texts=stored_texts(spark, sf_dir)))


# ---- roll-ups of the robustness report ------------------------------------------------------------

REPORT_KEYS = ["model", "task", "perturbation", "level", "language"]
FAMILIES = ["char_delete", "char_swap", "vowel_drop", "codemix", "paraphrase"]


def _report_sql(body: str, extra=None) -> str:
    return O.with_(O.paired_ctes() + O.paired_report_ctes(REPORT_KEYS) + (extra or []), body)


def _avg_cols(prefix="") -> str:
    return ", ".join(O.r6(f"avg({prefix}{c})", c) for c in RP.ROLLUP)


@register("summary_model", lambda: _report_sql(f"SELECT model, {_avg_cols()} FROM report GROUP BY model"))
def summary_model(spark, sf_dir):
    """Mean clean/perturbed accuracy, relative drop and consistency per model."""
    return rounded(RP.summary(stored_report(spark, sf_dir), ["model"]))


@register("summary_language", lambda: _report_sql(f"SELECT model, language, {_avg_cols()} FROM report GROUP BY ALL"))
def summary_language(spark, sf_dir):
    """Same per (model, language)."""
    return rounded(RP.summary(stored_report(spark, sf_dir), ["model", "language"]))


@register("summary_perturbation", lambda: _report_sql(
    f"SELECT model, perturbation, {_avg_cols()} FROM report GROUP BY ALL"))
def summary_perturbation(spark, sf_dir):
    """Same per (model, perturbation)."""
    return rounded(RP.summary(stored_report(spark, sf_dir), ["model", "perturbation"]))


@register("summary_sets", lambda: _report_sql(
    f"SELECT model, language, CAST(grouping(language) AS TINYINT) AS all_languages, {_avg_cols()} FROM report "
    "GROUP BY GROUPING SETS ((model), (model, language))"))
def summary_sets(spark, sf_dir):
    """Per-model and per-(model, language) summaries fused in one GROUPING SETS aggregate (F11 + F12)."""
    return rounded(RP.summary_sets(stored_report(spark, sf_dir)))


@register("drop_pivot", lambda: _report_sql(
    "SELECT model, language, " + ", ".join(
        f"round(avg(CASE WHEN perturbation = {O.q(f)} THEN rel_drop_acc * 100.0 END), 6) AS {f}" for f in FAMILIES)
    + " FROM report GROUP BY model, language"))
def drop_pivot(spark, sf_dir):
    """Relative accuracy drop in percent per (model, language), one column per perturbation family (F12 table)."""
    return rounded(RP.drop_pivot(stored_report(spark, sf_dir), FAMILIES))


@register("cross_lingual_gap", lambda: _report_sql(
    """SELECT r.model, r.task, r.perturbation, r.level, r.language,
       round(r.acc_perturbed - e.acc_perturbed, 6) AS acc_gap, round(r.rel_drop_acc - e.rel_drop_acc, 6) AS rel_drop_gap
     FROM report r JOIN report e ON e.language = 'en' AND r.model = e.model AND r.task = e.task
       AND r.perturbation = e.perturbation AND r.level = e.level"""))
def cross_lingual_gap(spark, sf_dir):
    """Perturbed accuracy and relative drop of each language minus English, same run."""
    return rounded(RP.cross_lingual_gap(stored_report(spark, sf_dir)))


@register("sorted_summary", lambda: _report_sql(
    f"SELECT model, language, {_avg_cols()} FROM report GROUP BY ALL ORDER BY model, language"))
def sorted_summary(spark, sf_dir):
    """Group keys in sorted order, as the pandas roll-ups emit them (ordering on the output only)."""
    return rounded(RP.summary(stored_report(spark, sf_dir), ["model", "language"])).orderBy("model", "language")


BOOT_B = 1000


def _boot_sql(keys: list[str], value: str, filt: str = "") -> str:
    k = ", ".join(keys)
    rid = "concat_ws('|', model, task, perturbation, CAST(level AS VARCHAR), language)"
    ths = RP.poisson_thresholds()
    w = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in ths)
    return _report_sql(f"""SELECT {k}, round(avg(x), 6) AS mean, count(x) AS n, round(any_value(lo), 6) AS ci_low,
    round(any_value(hi), 6) AS ci_high FROM (
  SELECT r.*, {value} AS x FROM report r {filt}) base LEFT JOIN (
  SELECT {k}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM (
    SELECT {k}, b, sum(wt * x) / nullif(sum(CASE WHEN x IS NOT NULL THEN wt END), 0) AS m FROM (
      SELECT *, {w} AS wt FROM (
        SELECT {k}, x, b, {O.draw_cols('kk', 'b')} FROM (
          SELECT {k}, {value} AS x, {O.key_sql("'boot'", rid)} AS kk, unnest(range(1, {BOOT_B + 1})) AS b
          FROM report r {filt})))
    GROUP BY ALL) GROUP BY ALL) ci USING ({k})
  GROUP BY ALL""")


def _boot(spark, sf_dir, keys, value_col, filt=None):
    rep = stored_report(spark, sf_dir)
    if filt is not None:
        rep = rep.filter(filt)
    rid = F.concat_ws("|", "model", "task", "perturbation", F.col("level").cast("string"), "language")
    return rounded(RP.bootstrap_ci(rep.withColumn("_v", value_col), keys, "_v", rid, BOOT_B)
                   .select(*keys, "mean", "n", "ci_low", "ci_high"))


@register("bootstrap_ci", lambda: _boot_sql(["model", "perturbation"], "acc_perturbed"))
def bootstrap_ci(spark, sf_dir):
    """Mean perturbed accuracy per (model, perturbation) with a 95 % Poisson-bootstrap interval."""
    return _boot(spark, sf_dir, ["model", "perturbation"], F.col("acc_perturbed"))


@register("perf_vs_noise", lambda: _boot_sql(["level", "perturbation", "model"], "acc_perturbed", "WHERE level > 0"))
def perf_vs_noise(spark, sf_dir):
    """Accuracy against noise level per perturbation and model, mean with 95 % interval."""
    return _boot(spark, sf_dir, ["level", "perturbation", "model"], F.col("acc_perturbed"), F.col("level") > 0)


@register("drop_by_language", lambda: _boot_sql(["language", "model"], "rel_drop_acc * 100.0",
                                                "WHERE perturbation <> 'clean'"))
def drop_by_language(spark, sf_dir):
    """Relative drop in percent per language and model, clean excluded, mean with interval."""
    return _boot(spark, sf_dir, ["language", "model"], F.col("rel_drop_acc") * 100.0,
                 F.col("perturbation") != "clean")


@register("consistency_by_type", lambda: _boot_sql(["perturbation", "language"], "consistency * 100.0",
                                                   "WHERE perturbation <> 'clean'"))
def consistency_by_type(spark, sf_dir):
    """Consistency in percent per perturbation and language, mean with interval (F16)."""
    return _boot(spark, sf_dir, ["perturbation", "language"], F.col("consistency") * 100.0, F.col("perturbation") != "clean")


# ---- dataset statistics -------------------------------------------------------------------------

def _stats_input_sql() -> str:
    k = O.key_sql("'split'", "id")
    thr = O.thr(str(fixed.VALIDATION_FRACTION))
    return f"""WITH q AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS language, 'quality' AS task FROM documents d),
  s AS (SELECT id, language, task, CASE WHEN u < {thr} THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT *, {O.draw_cols(k, '0')} FROM q)
        UNION ALL SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR), 'unknown', 'dialog', 'train'
          FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
           AND u.role = 'user' AND a.role = 'assistant'
        UNION ALL SELECT CAST(item_id AS VARCHAR), 'unknown', 'benchmark', 'train' FROM benchmark)"""


@register("dataset_stats", lambda: _stats_input_sql() + """
  SELECT task, split, language, CAST(grouping(language) AS TINYINT) AS all_languages, count(*) AS n
  FROM s GROUP BY GROUPING SETS ((task, split), (task, split, language))""")
def dataset_stats(spark, sf_dir):
    """Count per split and per language within split, in one GROUPING SETS aggregate."""
    from tremor.operators.stats import dataset_stats as ds

    q = sampling.split_hash(tables.scan_task(spark, sf_dir, "quality"))
    t = q.unionByName(tables.scan_task(spark, sf_dir, "dialog")).unionByName(
        tables.scan_task(spark, sf_dir, "benchmark"))
    return ds(t)
