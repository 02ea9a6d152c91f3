"""Base views: standardized examples, the experiment grid, and the scored run tables.

`paired` is the fast path: each (example, model, perturbation, level) row carries both the clean
and the perturbed prediction, so metrics need no join; `runs` is the long table (one row per
prediction, clean included once as level 0) used by the stored-analysis operators.  Both come out of
one crossing into Python (`operators.one_pass`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import fixed
from tremor.functions.text import normalize, pair_json
from tremor.operators import one_pass as OP
from tremor.operators import score as S
from tremor.operators.config import BROADCAST_ROWS, config_table, dealt
from tremor.sources import tables

DEFAULT_PERTURBATIONS = [
    ("char_delete", [0.1, 0.3]),
    ("char_swap", [0.1, 0.3]),
    ("vowel_drop", [0.3]),
    ("codemix", [0.5]),
    ("paraphrase", [0.5]),
]

RUN_KEYS = ["model", "task", "perturbation", "level", "language"]


def grid(spark: SparkSession, perturbations=None, include_clean: bool = False) -> DataFrame:
    """(perturbation, level) rows; a type without levels gets [0.1]; 'clean' entries are skipped."""
    rows = []
    for ptype, levels in (perturbations if perturbations is not None else DEFAULT_PERTURBATIONS):
        if ptype == "clean":
            continue
        for lv in (levels if levels else [fixed.DEFAULT_LEVEL]):
            rows.append((ptype, float(lv)))
    if include_clean:
        rows.insert(0, ("clean", 0.0))
    return config_table(spark, rows, "perturbation string, level double")


def grid_list(perturbations=None) -> list[tuple[str, float]]:
    """The grid as rows, without the clean one (a type without levels gets [0.1])."""
    return [(p, float(lv)) for p, levels in (DEFAULT_PERTURBATIONS if perturbations is None else perturbations)
            for lv in (levels or [fixed.DEFAULT_LEVEL]) if p != "clean"]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized classification examples (documents; those without a quality label have label '-1')."""
    return dealt(tables.scan_task(spark, sf_dir, "quality")).withColumn("text", normalize("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized pair examples (user turn -> following assistant turn)."""
    return dealt(tables.scan_task(spark, sf_dir, "dialog")).withColumns(
        {"premise": normalize("premise"), "hypothesis": normalize("hypothesis")})


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized unlabelled examples."""
    return tables.scan_task(spark, sf_dir, "benchmark").withColumn("text", normalize("text"))


def task_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks, normalized."""
    return examples(spark, sf_dir).unionByName(pairs(spark, sf_dir)).unionByName(benchmark(spark, sf_dir))


TASKS = ("quality", "dialog", "benchmark")


def _filled(df: DataFrame, task: str) -> DataFrame:
    """A missing field of the task's own kind is an empty one; the other kind's stay null."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in (("premise", "hypothesis") if task == "dialog" else ("text",))})


def raw_examples(spark: SparkSession, sf_dir: str, tasks=TASKS) -> DataFrame:
    """The named tasks as loaded; normalizing is left to the crossing."""
    out = None
    for t in tasks:
        df = _filled(tables.scan_task(spark, sf_dir, t), t)
        out = df if out is None else out.unionByName(df)
    return out


def dealt_examples(spark: SparkSession, sf_dir: str, keys) -> DataFrame:
    """`raw_examples` of all tasks, dealt by `keys` (task, language and id) to the session's number of shuffle partitions
    (a smaller number would be raised to it by the join with the labels).

    The documents' texts move once: they are dealt without their labels, which come to them as narrow rows of the same
    keys and are looked up in a hash table per partition, so no text is sorted either.  Documents without a language
    equal no key and are joined to their labels by doc_id before they are dealt.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text", F.col("lang").alias("language"))
    texts = _filled(tables.standardize(docs.filter(F.col("language").isNotNull()), "quality"), "quality")
    texts = texts.unionByName(raw_examples(spark, sf_dir, ("dialog", "benchmark"))).repartition(n, *keys)
    labels = tables.quality_labels(spark, sf_dir).withColumnRenamed("label", "_label").repartition(n, *keys)
    known = texts.join(labels.hint("shuffle_hash"), list(keys), "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")
    other = raw_examples(spark, sf_dir, ("quality",)).filter(F.col("language").isNull())
    return known.unionByName(other.repartition(n, *keys))


def rule_models(models=None) -> list[OP.RuleModels]:
    """The rule models as one predictor; `models` as (model, threshold) pairs or table, or predictors already."""
    if isinstance(models, DataFrame):
        models = [(r["model"], float(r["threshold"])) for r in models.limit(BROADCAST_ROWS).collect()]
    if models and not isinstance(models[0], tuple):
        return list(models)
    return [OP.RuleModels(tuple(models or S.DEFAULT_MODELS))]


def paired(spark: SparkSession, sf_dir: str, grid_df=None, models=None, base: DataFrame | None = None, perturber=None) -> DataFrame:
    """One row per (model, example, perturbation, level) with clean and perturbed prediction side by side.

    Plan: scan -> one Arrow crossing (normalize, perturb under the whole grid, predict) -> explode.  The grid
    (pairs or a small table) and the models (rule thresholds or predictors) are in the closure.  No shuffle of text
    after the label join.
    """
    base = dealt(raw_examples(spark, sf_dir)) if base is None else base
    g = grid_list() if grid_df is None else OP.grid_rows(grid_df)
    ps = rule_models(models)
    x = OP.paired_rows(OP.crossed(base, g, ps, perturber), g, ps)
    return x.select(*RUN_KEYS, "id", "label", "pred_clean", "score_clean", "pred_pert", "score_pert")


def stored_text(fields) -> Column:
    """Text as stored with a prediction: the text, or compact JSON of a pair."""
    return (F.when(fields["premise"].isNotNull() & fields["hypothesis"].isNotNull(), pair_json(fields["premise"], fields["hypothesis"]))
            .otherwise(F.coalesce(fields["text"], F.lit(""))))


def runs(spark: SparkSession, sf_dir: str, grid_df=None, models=None, base: DataFrame | None = None, perturber=None) -> DataFrame:
    """Long prediction table: model, task, perturbation, level, language, id, text, label, prediction, score.

    Clean is scored once per example (level 0.0), each perturbation once per (example, level).
    """
    base = dealt(raw_examples(spark, sf_dir)) if base is None else base
    g = grid_list() if grid_df is None else OP.grid_rows(grid_df)
    ps = rule_models(models)
    x = OP.long_rows(OP.crossed(base, g, ps, perturber, with_text=True), g, ps, text=True)
    return x.select(*RUN_KEYS, "id", stored_text(F.col("fields")).alias("text"), "label", "prediction", "score")
