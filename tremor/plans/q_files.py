"""Sink and scan queries (A3-A13, F22): write to a fresh folder under spark.checkpoint.dir, read back, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import fixed
from tremor.functions import text as T
from tremor.operators import metrics as M
from tremor.operators import pairs as PR
from tremor.operators import reports as RP
from tremor.operators import sampling
from tremor.operators.stats import dataset_stats
from tremor.plans import oracle as O
from tremor.plans import q_analysis as QA
from tremor.plans import views as V
from tremor.plans.catalog import register, rounded
from tremor.plans.experiment import experiment_report
from tremor.plans.stored import REPORT_SCHEMA as STORED_REPORT
from tremor.plans.stored import stored_report, stored_runs, stored_texts
from tremor.session import scratch_path
from tremor.sources import files, tables

REPORT_KEYS = ["model", "task", "perturbation", "level", "language"]


def _split_examples(spark, sf_dir, tasks=("quality", "dialog", "benchmark")):
    """Standardized, normalized tasks with the seeded 10 % validation split (no task has one of its own)."""
    out = None
    for t in tasks:
        df = tables.scan_task(spark, sf_dir, t)
        df = T.normalize_fields(df, "classification" if t != "dialog" else "nli")
        df = sampling.split_hash(df)
        out = df if out is None else out.unionByName(df)
    return out


def _split_sql(tasks=("quality", "dialog", "benchmark")) -> str:
    from tremor.plans.q_text import _benchmark_raw_sql, _pairs_raw_sql, _quality_raw_sql

    n = O.normalize_sql
    parts = {
        "quality": f"SELECT id, language, task, {n('text')} AS text, premise, hypothesis, label FROM ({_quality_raw_sql()})",
        "dialog": "SELECT id, language, task, text, premise, hypothesis, label FROM (" + _pairs_raw_sql(True) + ")",
        "benchmark": f"SELECT id, language, task, {n('text')} AS text, premise, hypothesis, label FROM ({_benchmark_raw_sql()})",
    }
    union = " UNION ALL ".join(parts[t] for t in tasks)
    k = O.key_sql("'split'", "id")
    return f"""SELECT id, language, task, text, premise, hypothesis, label,
    CASE WHEN u < {O.thr(str(fixed.VALIDATION_FRACTION))} THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, {O.draw_cols(k, '0')} FROM ({union}))"""


@register("sink_jsonl", _split_sql)
def sink_jsonl(spark, sf_dir):
    """Standardized splits written as JSON lines partitioned by task/split, non-ASCII unescaped; read back (A3)."""
    path = files.write_jsonl(_split_examples(spark, sf_dir), scratch_path(spark, "jsonl"), ("task", "split"))
    return files.read_jsonl(spark, path, files.EXAMPLE_SCHEMA)


@register("prepare", lambda: f"""WITH s AS ({_split_sql()})
  SELECT task, split, language, CAST(grouping(language) AS TINYINT) AS all_languages, count(*) AS n
  FROM s GROUP BY GROUPING SETS ((task, split), (task, split, language))""")
def prepare(spark, sf_dir):
    """Data preparation: load, standardize, normalize, split, write JSONL, then statistics over the written
    output (a second aggregate, not a re-run of normalization) (F22)."""
    path = files.write_jsonl(_split_examples(spark, sf_dir), scratch_path(spark, "prepared"), ("task", "split"))
    return dataset_stats(files.read_jsonl(spark, path, files.EXAMPLE_SCHEMA))


_RUNS_OUT = "SELECT model, task, perturbation, level, language, id, text, label, prediction, round(score, 6) AS score FROM runs"


@register("sink_preds", lambda: QA._runs_sql(_RUNS_OUT))
def sink_preds(spark, sf_dir):
    """Prediction table written as CSV partitioned by model/task/perturbation (quotes escaped); read back (A4)."""
    path = files.write_predictions(V.runs(spark, sf_dir), scratch_path(spark, "preds"), "csv", as_they_lie=True, compression="gzip")
    return rounded(files.read_predictions(spark, path, "csv"))


@register("scan_preds", lambda: QA._runs_sql(_RUNS_OUT))
def scan_preds(spark, sf_dir):
    """Recursive scan of stored prediction CSVs with id forced to string; metadata from file paths."""
    path = files.write_predictions(V.runs(spark, sf_dir), scratch_path(spark, "preds"), "csv", as_they_lie=True, compression="gzip")
    df = files.scan_predictions(spark, path)
    return rounded(df.select("model", "task", "perturbation", "level", "language", "id", "text", "label",
                             "prediction", "score"))


METRICS_SCHEMA = ("model string, task string, perturbation string, level double, language string, accuracy double, "
                  "f1_macro double, n long, classes string, confusion_matrix string")


@register("sink_metrics", lambda: QA._runs_sql(QA.MATRIX_SQL, QA._metrics_sql_ctes() + QA.MATRIX_CTES))
def sink_metrics(spark, sf_dir):
    """Per-language metrics with their confusion matrix written as JSON and read back (A5)."""
    met = M.with_matrix(M.all_metrics(stored_runs(spark, sf_dir, text=False), REPORT_KEYS), REPORT_KEYS)
    path = files.write_jsonl(met, scratch_path(spark, "metrics"))
    return rounded(files.read_jsonl(spark, path, METRICS_SCHEMA))


REPORT_SCHEMA = ("language string, " + ", ".join(f"{c} double" for c in files.METRIC_FIELDS)
                 + ", n long, model string, task string, perturbation string, level double")


def _report_sql(body: str) -> str:
    return O.with_(O.paired_ctes() + O.paired_report_ctes(REPORT_KEYS), body)


@register("sink_robustness", lambda: _report_sql(O.report_select(REPORT_KEYS)))
def sink_robustness(spark, sf_dir):
    """Robustness report written partitioned by model/task/perturbation/level and read back."""
    rep = experiment_report(spark, sf_dir)
    path = files.write_jsonl(rep, scratch_path(spark, "robustness"), ("model", "task", "perturbation", "level"))
    return rounded(files.read_jsonl(spark, path, REPORT_SCHEMA))


def _metric_cols_sql() -> str:
    return ", ".join(O.r6(c, c) for c in files.METRIC_FIELDS)


@register("scan_reports", lambda: _report_sql(
    f"SELECT model, task, perturbation, level, language, {_metric_cols_sql()} FROM report"))
def scan_reports(spark, sf_dir):
    """Report files `{language: {metrics}}` scanned recursively, one row per (file, language)."""
    path = files.write_report_files(stored_report(spark, sf_dir), scratch_path(spark, "reports"))
    rows = files.scan_report_files(spark, path)
    meta = files.parse_report_path(F.col("file_path"))
    return rounded(rows.select(*[v.alias(k) for k, v in meta.items()], "language", *files.METRIC_FIELDS))


@register("report_long", lambda: _report_sql(
    """SELECT model, task, perturbation, level, language, round(coalesce(acc_perturbed, 0.0), 6) AS accuracy,
       round(coalesce(rel_drop_acc, 0.0) * 100.0, 6) AS rel_drop, round(coalesce(consistency, 0.0) * 100.0, 6)
       AS consistency FROM report"""))
def report_long(spark, sf_dir):
    """Plot-ready long table from the report files: accuracy, relative drop and consistency in percent (A10)."""
    path = files.write_report_files(stored_report(spark, sf_dir), scratch_path(spark, "reports"))
    return rounded(files.report_long(files.scan_report_files(spark, path, reports_only=False)))


def _parse_paths_sql() -> str:
    base = "regexp_extract(path, '([^/]+)$', 1)"
    parent = "regexp_extract(path, '([^/]+)/[^/]+$', 1)"
    leg = r"^([^_]+)_(?:(.*)_)?([^_]+)\.json$"
    lvl = f"TRY_CAST(regexp_extract({base}, '{leg}', 3) AS DOUBLE)"
    ok = f"(regexp_matches({base}, '{leg}') AND {lvl} IS NOT NULL)"
    clean = f"contains({base}, 'clean')"
    return _report_sql(f"""SELECT path,
    CASE WHEN {parent} = 'metrics' THEN 'unknown' ELSE {parent} END AS model,
    CASE WHEN {ok} THEN regexp_extract({base}, '{leg}', 1) WHEN {clean} THEN regexp_extract({base}, '^([^_.]+)', 1) END AS task,
    CASE WHEN {ok} THEN regexp_extract({base}, '{leg}', 2) WHEN {clean} THEN 'clean' END AS perturbation,
    CASE WHEN {ok} THEN {lvl} WHEN {clean} THEN 0.0 END AS level
  FROM (SELECT DISTINCT model || '/' || task || '_' || perturbation || '_' || CAST(level AS VARCHAR) || '.json' AS path
        FROM report UNION SELECT 'metrics/' || task || '_clean_metrics.json' FROM report)""")


@register("parse_paths", _parse_paths_sql)
def parse_paths(spark, sf_dir):
    """Report files `{model}/{task}_{perturbation}_{level}.json` written, listed and their names parsed, none opened;
    perturbation names with underscores stay whole; `*_clean_*` names give level 0 (A9)."""
    root = files.write_legacy_reports(stored_report(spark, sf_dir), scratch_path(spark, "named-reports"))
    listed = files.list_files(spark, root, "*.json")
    meta = files.parse_report_path(F.col("path"))
    return listed.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), *[v.alias(k) for k, v in meta.items()])


SUMMARY_SCHEMA = "model string, acc_clean double, acc_perturbed double, rel_drop_acc double, consistency double"


@register("sink_summary", lambda: _report_sql(
    "SELECT model, " + ", ".join(O.r6(f"avg({c})", c) for c in RP.ROLLUP) + " FROM report GROUP BY model"))
def sink_summary(spark, sf_dir):
    """Roll-ups written (by model, by language, flat as CSV and as JSON); the by-model table read back."""
    root = files.write_summaries(stored_report(spark, sf_dir), scratch_path(spark, "summary"))
    return rounded(files.read_csv(spark, f"{root}/summary_overall_model", SUMMARY_SCHEMA))


@register("sink_summary_language", lambda: _report_sql(
    "SELECT model, language, " + ", ".join(O.r6(f"avg({c})", c) for c in RP.ROLLUP) + " FROM report GROUP BY model, language"))
def sink_summary_language(spark, sf_dir):
    """The by-language table of the same output."""
    root = files.write_summaries(stored_report(spark, sf_dir), scratch_path(spark, "summary"))
    return rounded(files.read_csv(spark, f"{root}/summary_by_language", SUMMARY_SCHEMA.replace("model string, ", "model string, language string, ")))


@register("sink_flat", lambda: _report_sql(
    "SELECT s.source, model, task, perturbation, level, language, " + _metric_cols_sql()
    + ", CAST(n AS BIGINT) AS n FROM report, (VALUES ('csv'), ('json')) s(source)"))
def sink_flat(spark, sf_dir):
    """The flat report of the same output, from its CSV and from its JSON."""
    root = files.write_summaries(stored_report(spark, sf_dir), scratch_path(spark, "summary"))
    as_csv = files.read_csv(spark, f"{root}/all_results_flat", STORED_REPORT)
    as_json = files.read_jsonl(spark, f"{root}/all_results", STORED_REPORT)
    return rounded(as_csv.withColumn("source", F.lit("csv")).unionByName(as_json.withColumn("source", F.lit("json"))))


def _flips_sql() -> str:
    keys = "model, task, language, perturbation, level"
    one = """'{"id":"' || id || '","label":"' || label || '","clean_pred":"' || clean_pred || '","pert_pred":"' || pert_pred || '"}'"""
    return QA._runs_sql(f"""SELECT {keys}, total_samples, flipped_count AS flip_count, flip_rate, '[' || coalesce(s.list, '') || ']' AS samples
  FROM ({QA._stats_sql(keys)}) t LEFT JOIN (
    SELECT {keys}, string_agg({one}, ',' ORDER BY u, id) AS list FROM (
      SELECT *, {O.draw_cols(O.key_sql("'sample'", 'id'), '0')} FROM ({QA._sample_sql()})) GROUP BY ALL) s USING ({keys})""", [QA.PJ, QA.CMP])


FLIP_SCHEMA = ("model string, task string, language string, perturbation string, level double, total_samples long, flip_count long, flip_rate double, "
               "samples array<struct<id:string,label:string,clean_pred:string,pert_pred:string>>")


@register("sink_flips", _flips_sql)
def sink_flips(spark, sf_dir):
    """Flip report with its samples written as JSON and read back."""
    r = stored_runs(spark, sf_dir, text=False)
    rep = RP.flip_report(M.stats_from_counts(PR.comparison_counts(r)), RP.sampled_flips(PR.pair_join(r)))
    path = files.write_jsonl(rep, scratch_path(spark, "flips"))
    return rounded(files.read_jsonl(spark, path, FLIP_SCHEMA).withColumn("samples", F.to_json("samples")))


ERROR_SCHEMA = ("type string, model string, task string, language string, perturbation string, level double, "
                "id string, text_clean string, text_perturbed string, pred_clean string, pred_perturbed string, "
                "ground_truth string, prediction string, confidence double")


@register("sink_errors", lambda: QA._runs_sql(QA._errors_sql(), [QA.PJ]))
def sink_errors(spark, sf_dir):
    """Error cases written as UTF-8 JSON and read back."""
    e = RP.error_cases(PR.pair_join(stored_runs(spark, sf_dir)), texts=stored_texts(spark, sf_dir))
    path = files.write_jsonl(e, scratch_path(spark, "errors"))
    return rounded(files.read_jsonl(spark, path, ERROR_SCHEMA))


DETAIL_SCHEMA = ("model string, task string, language string, perturbation string, level double, id string, "
                 "label string, prediction_clean string, prediction_pert string, is_consistent boolean")
STATS_SCHEMA = ("model string, task string, language string, perturbation string, level double, total_samples long, "
                "consistent_count long, flipped_count long, consistency double, flip_rate double")


@register("sink_consistency", lambda: QA._runs_sql(
    "SELECT d.*, s.total_samples, s.flip_rate FROM (" + QA._detail_body() + ") d JOIN ("
    + QA._stats_sql("model, task, language, perturbation, level") + ") s USING (model, task, language, perturbation, level)",
    [QA.PJ, QA.CMP]))
def sink_consistency(spark, sf_dir):
    """Consistency report: summary table and every compared example, two writes, joined back on read."""
    pj = PR.pair_join(stored_runs(spark, sf_dir, text=False))
    detail = pj.select(*QA.GROUP, "id", F.col("label_clean").alias("label"), "prediction_clean", "prediction_pert",
                       F.coalesce(F.col("prediction_clean") == F.col("prediction_pert"), F.lit(False))
                       .alias("is_consistent"))
    stats = M.stats_from_counts(PR.comparison_counts(stored_runs(spark, sf_dir, text=False)))
    root = scratch_path(spark, "consistency")
    files.write_jsonl(detail, f"{root}/details")
    files.write_jsonl(stats, f"{root}/summary")
    d = files.read_jsonl(spark, f"{root}/details", DETAIL_SCHEMA)
    s = files.read_jsonl(spark, f"{root}/summary", STATS_SCHEMA).select(*QA.GROUP, "total_samples", "flip_rate")
    return rounded(d.join(s, QA.GROUP))
