"""End-to-end experiment queries (F19-F21): grid -> perturb -> predict -> robustness report, for any predictor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import metrics as M
from tremor.operators import one_pass as OP
from tremor.operators import sampling
from tremor.operators import score as S
from tremor.plans import oracle as O
from tremor.plans import views as V
from tremor.plans.catalog import register, rounded

KEYS = V.RUN_KEYS


def chosen(examples: DataFrame, languages: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Examples of the named languages (a missing one counts as 'unknown'), then the first `limit` of each task by id."""
    if languages is not None:
        examples = examples.filter(F.coalesce("language", F.lit("unknown")).isin(list(languages)))
    return sampling.limit_per_task(examples, limit)


def run_experiment(examples: DataFrame, predictors: Sequence, perturbations=None, languages: Sequence[str] | None = None,
                   limit: int | None = None, perturber=None) -> DataFrame:
    """Robustness report of any predictors over raw standard examples: one row per (model, task, perturbation, level,
    language).

    `predictors` are `one_pass.Predictor` or `one_pass.RuleModels`; `perturbations` as in the configuration, (type,
    levels) pairs.  The examples cross into Python once, whatever the size of the grid and the number of models.
    """
    g = V.grid_list(perturbations)
    x = OP.crossed(chosen(examples, languages, limit), g, predictors, perturber)
    return M.paired_report(OP.paired_rows(x, g, predictors), KEYS)


def configured(spark: SparkSession, config: dict, load, predictors: dict) -> DataFrame:
    """A whole configuration: tasks (name, type), models (name), perturbations (type, levels), languages and
    limit_samples, with the keys of the experiment files.

    `load(spark, name, type)` gives a task's standard examples; `predictors` maps model names to predictors, and a
    model that it lacks fails before anything runs.
    """
    unknown = [m["name"] for m in config["models"] if m["name"] not in predictors]
    if unknown:
        raise ValueError(f"no predictor for {unknown}")
    base = None
    for t in config["tasks"]:
        df = load(spark, t["name"], t.get("type", "classification"))
        base = df if base is None else base.unionByName(df)
    grid = [(p["type"], p.get("levels") or []) for p in config["perturbations"]]
    limit = config.get("limit_samples")
    return run_experiment(base, [predictors[m["name"]] for m in config["models"]], grid, config.get("languages"), limit)


def experiment_report(spark, sf_dir, grid_df=None, models=None, base=None):
    paired = V.paired(spark, sf_dir, grid_df=grid_df, models=models, base=base)
    return M.paired_report(paired, KEYS)


def _experiment_sql() -> str:
    return O.with_(O.paired_ctes() + O.paired_report_ctes(KEYS), O.report_select(KEYS))


@register("experiment", _experiment_sql)
def experiment(spark, sf_dir):
    """Whole experiment: one row per (model, task, perturbation, level, language)."""
    return rounded(experiment_report(spark, sf_dir))


@register("experiment_plugin", lambda: _experiment_sql().replace("'stopword-t20', 0.2", "'plugin-a', 0.2").replace("'stopword-t30', 0.3", "'plugin-b', 0.3"))
def experiment_plugin(spark, sf_dir):
    """The same experiment with two plain Python predictors (list in, list of dicts or tuples out), each loaded once
    per worker and fed batches across grid rows; all examples still cross once."""
    predictors = [OP.Predictor("plugin-a", S.stopword_predictor_factory(0.2)),
                  OP.Predictor("plugin-b", S.stopword_predictor_factory(0.3), batch_size=16)]
    return rounded(run_experiment(V.dealt(V.raw_examples(spark, sf_dir)), predictors))


def _options_sql() -> str:
    ctes = O.paired_ctes(O.grid_values([p for p in _OPTIONS["perturbations"] if p[0] != "clean"]))
    at = next(i for i, c in enumerate(ctes) if c.startswith("tasks AS"))
    langs = ", ".join(O.q(x) for x in _OPTIONS["languages"])
    picked = f"""tasks AS (SELECT * FROM all_tasks WHERE task IN ('quality', 'dialog') AND coalesce(language, 'unknown') IN ({langs})
  QUALIFY row_number() OVER (PARTITION BY task ORDER BY id) <= {_OPTIONS["limit"]})"""
    ctes[at:at + 1] = [ctes[at].replace("tasks AS", "all_tasks AS", 1), picked]
    return O.with_(ctes + O.paired_report_ctes(KEYS), O.report_select(KEYS, "WHERE model = 'stopword-t20'"))


_OPTIONS = {"languages": ["en", "es", "unknown"], "limit": 150, "perturbations": [("char_delete", [0.2]), ("clean", []), ("codemix", [])]}


@register("experiment_options", _options_sql)
def experiment_options(spark, sf_dir):
    """An experiment from a configuration: two of the tasks, one model, three languages, 150 samples a task, a level
    left to its default."""
    config = {"tasks": [{"name": "quality"}, {"name": "dialog", "type": "nli"}], "models": [{"name": "stopword-t20"}],
              "languages": _OPTIONS["languages"], "limit_samples": _OPTIONS["limit"],
              "perturbations": [{"type": p, "levels": lv} if lv else {"type": p} for p, lv in _OPTIONS["perturbations"]]}
    predictors = {name: OP.RuleModels(((name, t),)) for name, t in S.DEFAULT_MODELS}
    return rounded(configured(spark, config, lambda s, name, kind: V.raw_examples(s, sf_dir, [name]), predictors))


def _task_sql(task: str) -> str:
    return O.with_(O.paired_ctes() + O.paired_report_ctes(KEYS), O.report_select(KEYS, f"WHERE task = '{task}'"))


@register("report_classification", lambda: _task_sql("quality"))
def report_classification(spark, sf_dir):
    """Per-language robustness report of the classification task."""
    return rounded(experiment_report(spark, sf_dir, base=V.dealt(V.raw_examples(spark, sf_dir, ["quality"]))))


@register("report_pairs", lambda: _task_sql("dialog"))
def report_pairs(spark, sf_dir):
    """Same report for the pair (premise/hypothesis) task."""
    return rounded(experiment_report(spark, sf_dir, base=V.dealt(V.raw_examples(spark, sf_dir, ["dialog"]))))
