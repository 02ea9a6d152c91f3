"""Scoring-surface queries (E1-E5): rule model, plug-in predictor, batched/truncated input, naive Bayes, top-1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import fixed
from tremor.functions import text as T
from tremor.operators import sampling
from tremor.operators import score as S
from tremor.plans import oracle as O
from tremor.plans import views as V
from tremor.plans.catalog import register, rounded
from tremor.session import scratch_path


def _tasks_sql(body: str) -> str:
    return O.with_([O.examples_cte(), O.pairs_cte(), O.tasks_cte(), O.models_values()], body)


def _share(t: str) -> str:
    return f"(CAST({O.hits_sql(t)} AS DOUBLE) / CAST({O.tokens_sql(t)} AS DOUBLE))"


@register("score_rule", lambda: _tasks_sql(f"""SELECT m.model, t.task, t.id, {O.tokens_sql(O.input_sql('t.'))} AS n_tokens,
    {O.hits_sql(O.input_sql('t.'))} AS n_hits,
    CASE WHEN {_share(O.input_sql('t.'))} >= m.threshold THEN '1' ELSE '0' END AS prediction,
    round(CASE WHEN {_share(O.input_sql('t.'))} >= m.threshold THEN {_share(O.input_sql('t.'))}
               ELSE 1.0 - {_share(O.input_sql('t.'))} END, 6) AS score
  FROM tasks t CROSS JOIN models m"""))
def score_rule(spark, sf_dir):
    """Rule model over both tasks and every model of the grid: one Python split per text, thresholds in the JVM."""
    t = V.task_examples(spark, sf_dir).withColumn("input", T.format_input())
    st = S.rule_stats("input")
    t = t.withColumns({"n_tokens": st["n_tokens"], "n_hits": st["n_hits"]})
    out = S.score_stats(t, S.default_models(spark), "n_hits", "n_tokens")
    return rounded(out.select("model", "task", "id", "n_tokens", "n_hits", "prediction", "score"))


def _plugin_sql(input_expr: str, model: str) -> str:
    sh = _share(input_expr)
    return _tasks_sql(f"""SELECT '{model}' AS model, task, id,
    CASE WHEN {sh} >= 0.2 THEN '1' ELSE '0' END AS prediction,
    round(CASE WHEN {sh} >= 0.2 THEN {sh} ELSE 1.0 - {sh} END, 6) AS score FROM tasks""")


@register("score_plugin", lambda: _plugin_sql(O.input_sql(), "plugin-stopword"))
def score_plugin(spark, sf_dir):
    """A user predictor (plain Python, list in -> list out) run in an iterator Arrow UDF, loaded once per
    worker (E1).  The predictor here re-implements the rule model, so the result has an exact oracle."""
    t = V.task_examples(spark, sf_dir).withColumn("input", T.format_input())
    out = S.score_plugin(t, S.stopword_predictor_factory(0.2), "plugin-stopword", text="input")
    return rounded(out.select("model", "task", "id", "prediction", "score"))


def _input_v2_sql() -> str:
    return ("CASE WHEN premise IS NOT NULL AND hypothesis IS NOT NULL THEN concat_ws(' ', premise, hypothesis) "
            "WHEN text IS NOT NULL THEN text ELSE concat_ws(' ', premise, hypothesis) END")


@register("score_batch", lambda: _plugin_sql(_input_v2_sql(), "plugin-stopword-v2"))
def score_batch(spark, sf_dir):
    """Batched inference (batch 16) on the whole v2 input (E2; the cut to 100 characters is `format_truncate`)."""
    t = V.task_examples(spark, sf_dir).withColumn("input", T.format_truncate(max_chars=None))
    out = S.score_plugin(t, S.stopword_predictor_factory(0.2), "plugin-stopword-v2", text="input", batch_size=16)
    return rounded(out.select("model", "task", "id", "prediction", "score"))


def _bayes_sql() -> str:
    k = O.key_sql("'split'", "id")
    return O.with_([O.examples_cte(),
        f"""x AS (SELECT *, {O.input_sql()} AS input, CASE WHEN u < {O.thr(str(fixed.VALIDATION_FRACTION))} THEN 1 ELSE 0 END AS val
  FROM (SELECT *, {O.draw_cols(k, '0')} FROM examples WHERE label <> '-1'))""",
        "tok AS (SELECT id, label, val, w FROM (SELECT id, label, val, unnest(string_split(lower(input), ' ')) AS w FROM x) WHERE w <> '')",
        "cls AS (SELECT label AS c, ln(count(*) / (SELECT count(*) FROM x WHERE val = 0)) AS prior FROM x WHERE val = 0 GROUP BY label)",
        "cnt AS (SELECT label AS c, w, count(*) AS n FROM tok WHERE val = 0 GROUP BY ALL)",
        """den AS (SELECT c, prior, coalesce((SELECT sum(n) FROM cnt WHERE cnt.c = cls.c), 0) + (SELECT count(DISTINCT w) FROM cnt) AS d FROM cls)""",
        """lp AS (SELECT x.id, den.c, den.prior + coalesce(sum(ln((coalesce(cnt.n, 0) + 1.0) / den.d)) FILTER (WHERE tok.w IS NOT NULL), 0) AS s
  FROM x CROSS JOIN den LEFT JOIN tok ON tok.id = x.id LEFT JOIN cnt ON cnt.c = den.c AND cnt.w = tok.w WHERE x.val = 1
  GROUP BY x.id, den.c, den.prior)""",
        "best AS (SELECT id, arg_max(c, s) AS prediction, 1 / sum(exp(s - m)) AS score FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM lp) GROUP BY id)"],
        "SELECT 'naive-bayes' AS model, x.task, x.id, x.language, x.label, best.prediction, round(best.score, 6) AS score FROM x JOIN best USING (id)")


@register("score_ml", _bayes_sql)
def score_ml(spark, sf_dir):
    """Multinomial naive Bayes fitted by aggregates on the labelled train split, scoring the validation split."""
    ex = V.examples(spark, sf_dir).filter("label <> '-1'")
    ex = sampling.split_hash(ex).withColumn("input", T.format_input())
    model = S.fit_naive_bayes(ex.filter(F.col("split") == "train"), scratch_path(spark, "naive-bayes"))
    val = ex.filter(F.col("split") == "validation").select("id", "task", "language", "label", "input")
    out = S.score_naive_bayes(val, model)
    return rounded(out.select("model", "task", "id", "language", "label", "prediction", "score"))


@register("top1", lambda: _tasks_sql(f"""SELECT id, task,
    CASE WHEN {_share(O.input_sql())} > 1.0 - {_share(O.input_sql())} THEN '1' ELSE '0' END AS label_top1,
    round(greatest({_share(O.input_sql())}, 1.0 - {_share(O.input_sql())}), 6) AS score_top1 FROM tasks"""))
def top1(spark, sf_dir):
    """Top-1 label and score of a raw classifier output array<struct<label, score>> (ties: smaller label).

    The raw output is the two-class distribution {1: stop-word share, 0: 1 - share} of every example.
    """
    t = V.task_examples(spark, sf_dir).withColumn("input", T.format_input())
    st = S.rule_stats("input")
    share = st["n_hits"].cast("double") / st["n_tokens"].cast("double")
    raw = F.array(F.struct(F.lit("1").alias("label"), share.alias("score")),
                  F.struct(F.lit("0").alias("label"), (F.lit(1.0) - share).alias("score")))
    t = t.withColumn("raw", raw)
    lab, sc = S.top1("raw")
    return rounded(t.select("id", "task", lab.alias("label_top1"), sc.alias("score_top1")))


@register("route_input", lambda: _tasks_sql("""SELECT coalesce(id, '') AS id, task,
    CASE WHEN premise IS NOT NULL AND hypothesis IS NOT NULL THEN 'pair' ELSE 'text' END AS input_kind,
    CASE WHEN premise IS NOT NULL AND hypothesis IS NOT NULL THEN concat_ws(' ', premise, hypothesis)
         ELSE coalesce(text, '') END AS input FROM tasks"""))
def route_input(spark, sf_dir):
    """Pair input when premise and hypothesis exist, else the text (E5)."""
    return S.route_input(V.task_examples(spark, sf_dir)).select("id", "task", "input_kind", "input")
