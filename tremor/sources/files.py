"""File sinks and scans (A3-A13): partitioned JSON lines / CSV / parquet, report files, path metadata.

Metadata lives in partition directories (model=/task=/perturbation=/level=) instead of being spliced
into file names, so scans prune partitions; the legacy `{model}/{task}_{perturbation}_{level}.json`
names are still parsed by `parse_report_path` for files written by other tools.  Every read passes an
explicit schema: nothing is inferred.
"""

from __future__ import annotations

import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import unsorted_writes

EXAMPLE_SCHEMA = ("id string, language string, text string, premise string, hypothesis string, label string, "
                  "task string, split string")
# CSV columns are positional: the written order is fixed here (id, text, label, prediction, score first, as
# in the original files), followed by level and language; model/task/perturbation are directories.
PRED_DATA = "id string, text string, label string, prediction string, score double, level double, language string"
PRED_SCHEMA = PRED_DATA + ", model string, task string, perturbation string"
METRIC_FIELDS = ["acc_clean", "acc_perturbed", "abs_drop_acc", "rel_drop_acc", "f1_clean", "f1_perturbed",
                 "abs_drop_f1", "rel_drop_f1", "consistency"]
REPORT_MAP = "map<string, struct<" + ", ".join(f"{f}: double" for f in METRIC_FIELDS) + ">>"


# ---- JSON lines (A3, A5, A12) ----------------------------------------------------------------

#: Rows of one file at most.
FILE_ROWS = 1_000_000


def balanced(df: DataFrame, keys) -> DataFrame:
    """Rows in ranges of the directories they go to and, within one, of their content's hash.

    A task writes neighbouring directories, and a large directory is cut between tasks: the files are at most as many
    as directories and partitions together (adaptive execution joins small ranges up to its advisory size), where a
    partition by hash would leave one file per task and directory.
    """
    return df.repartitionByRange(*[F.col(k) for k in keys], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in keys]))


def write_jsonl(df: DataFrame, path: str, partition_by=()) -> str:
    w = (balanced(df, partition_by) if partition_by else df).write.mode("overwrite").option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by).option("maxRecordsPerFile", FILE_ROWS)
    w.json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


# ---- predictions (A4, A7) --------------------------------------------------------------------

CSV_OPTS = {"header": "true", "quote": "\"", "escape": "\"", "multiLine": "true", "encoding": "UTF-8",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# On read, only an unquoted empty field is null (as a pandas NaN); a quoted "" stays the empty string.
CSV_READ = {**CSV_OPTS, "nullValue": "\u0000"}


def write_predictions(runs: DataFrame, path: str, fmt: str = "csv", as_they_lie: bool = False, compression: str | None = None) -> str:
    """Predictions partitioned by model/task/perturbation; text keeps quotes and newlines (escape '"').

    A CSV file whose texts may hold newlines is read by one task, so files are kept to the advisory partition size.
    With `as_they_lie` every task writes its own rows, for runs straight from the crossing: an input split gives each
    run one file of about its own size, and no perturbed text is shuffled or sorted.
    """
    cols = [c.split()[0] for c in PRED_SCHEMA.split(", ")]
    keys = ["model", "task", "perturbation"]
    rows = runs.select(*cols)
    w = (rows if as_they_lie else balanced(rows, keys)).write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*keys)
    if compression:
        # (level 4, the first with lazy matching: 7 % smaller than level 1 in 1.2 times its time, level 6 takes 1.8 times)
        w = w.option("compression", compression).option("zlib.compress.level", "FOUR")
    with unsorted_writes(runs.sparkSession):
        if fmt == "csv":
            w.options(**CSV_OPTS).csv(path)
        else:
            w.parquet(path)
    return path


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Partition-discovery scan: model/task/perturbation come from the directories (typed by the schema)."""
    r = spark.read.schema(PRED_SCHEMA)
    return r.options(**CSV_READ).csv(path) if fmt == "csv" else r.parquet(path)


def _unescaped(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _escaped(name: str) -> str:
    return urllib.parse.quote(name, safe="!$&'()*+,;=:@-._~")


def _dir_value(path: Column, key: str) -> Column:
    """Value of a partition directory in a file URI, null without one; the URI's escapes and the directory's go."""
    return _unescaped(_unescaped(F.nullif(F.regexp_extract(path, f"/{key}=([^/]+)/", 1), F.lit(""))))


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Recursive scan of stored prediction CSVs (no partition inference); id forced to string and metadata
    recovered from each file's path via the hidden `_metadata.file_path` column."""
    df = (spark.read.schema(PRED_DATA).options(**CSV_READ).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.csv{,.gz}").csv(path))
    fp = F.col("_metadata.file_path")
    return df.select("*", *[_dir_value(fp, k).alias(k) for k in ("model", "task", "perturbation")])


LEGACY_PREDS = "id string, text string, label string, prediction string, score double"


def scan_legacy_predictions(spark: SparkSession, path: str, task: str | None = None, language: str | None = None) -> DataFrame:
    """Every `{task}_{perturbation}_{language}_preds.csv` under `path`, flat or nested.

    A task or language asked for is a condition on the file names: files of others are not opened.

    The five columns are read as written (id as string).  From the name: task is the first '_'-token, language the
    last, perturbation all between (null for a name of fewer than three tokens, which keeps its task); the model
    is the file's folder, unescaped.
    """
    df = (spark.read.schema(LEGACY_PREDS).options(**CSV_READ).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*_preds.csv").csv(path))
    name = F.col("_metadata.file_name")
    if task is not None:
        df = df.filter(name.startswith(_escaped(task) + "_"))
    if language is not None:
        df = df.filter(name.endswith("_" + _escaped(language) + "_preds.csv"))
    uri = F.col("_metadata.file_path")
    stem = _unescaped(F.regexp_extract(uri, r"([^/]+)_preds\.csv$", 1))
    parts = r"^([^_]+)_(.+)_([^_]+)$"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(stem, parts, i), F.lit(""))

    return df.select("*", _unescaped(_unescaped(F.regexp_extract(uri, r"([^/]+)/[^/]+$", 1))).alias("model"),
                     F.coalesce(part(1), F.regexp_extract(stem, r"^([^_]*)", 1)).alias("task"),
                     part(2).alias("perturbation"), part(3).alias("language"))


# ---- robustness report files (A6, A8, A9, A10) ------------------------------------------------

def write_report_files(report: DataFrame, path: str) -> str:
    """One `{language: {metrics}}` JSON document per (model, task, perturbation, level) directory.

    The per-group map holds one entry per language (bounded by the language count), built by a grouped
    aggregate; each directory then holds a single one-line text file.
    """
    keys = ["model", "task", "perturbation", "level"]
    entry = F.struct(F.col("language"), F.struct(*[F.col(f) for f in METRIC_FIELDS]))
    docs = (report.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
            .select(*keys, F.to_json("m").alias("value")))
    docs.write.mode("overwrite").partitionBy(*keys).text(path)
    return path


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of every file under `path` by name, as a table: a listing, no file is opened."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
            .select("path", "length"))


def write_legacy_reports(report: DataFrame, path: str) -> str:
    """The report as `{model}/{task}_{perturbation}_{level}.json` files, one `{language: {metrics}}` document each, and an
    empty `metrics/{task}_clean_metrics.json` per task.

    Spark writes one small document per run; the files (as many as runs, a configuration's number) are then given
    their names.
    """
    spark = report.sparkSession
    entry = F.struct(F.col("language"), F.struct(*[F.col(f) for f in METRIC_FIELDS]))
    name = F.concat_ws("_", "task", "perturbation", F.col("level").cast("string"))
    docs = (report.groupBy("model", name.alias("name")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
            .select("model", F.concat("name", F.lit(".json")).alias("file"), F.to_json("m").alias("value")))
    clean = report.select(F.lit("metrics").alias("model"), F.concat("task", F.lit("_clean_metrics.json")).alias("file"), F.lit("{}").alias("value")).distinct()
    docs.unionByName(clean).write.mode("overwrite").partitionBy("model", "file").text(f"{path}.parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    for r in list_files(spark, f"{path}.parts", "*.txt").select("path").collect():
        source = of(r["path"])
        fs = source.getFileSystem(conf)
        model, file = (urllib.parse.unquote(d.getName().split("=", 1)[1]) for d in (source.getParent().getParent(), source.getParent()))
        target = of(of(path, model), file)
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"could not name {target.toString()}")
    return path


def scan_report_files(spark: SparkSession, path: str, reports_only: bool = True) -> DataFrame:
    """Every report file under `path`, one row per (file, language).

    Whole `.json` (or one-document `.txt`) files are parsed as `map<language, struct<metrics>>`.  A malformed file
    parses to a null map and is dropped; with `reports_only` so is one whose first entry has no `acc_clean`.  Every
    language of a file that stays is kept, with nulls for what it lacks.
    """
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,txt}").text(path)
           .select(F.col("_metadata.file_path").alias("file_path"), "value"))
    parsed = raw.select("file_path", F.from_json("value", REPORT_MAP, {"mode": "PERMISSIVE"}).alias("m"))
    if reports_only:
        parsed = parsed.filter(F.get(F.map_values("m"), F.lit(0))["acc_clean"].isNotNull())
    return parsed.select("file_path", F.explode("m").alias("language", "r")).select("file_path", "language", "r.*")


def parse_report_path(path: Column) -> dict[str, Column]:
    """Metadata of a report path: partition directories when present, else the legacy file name.

    Legacy: model = parent directory ('metrics' -> 'unknown'); `{task}_{perturbation}_{level}.json` where the
    task is the first '_'-token, the level the last (a float) and the perturbation everything between;
    a name that fails this but contains 'clean' gives (first token, 'clean', 0.0); otherwise nulls (skipped).
    """
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    legacy = r"^([^_]+)_(?:(.*)_)?([^_]+)\.json$"
    lvl = F.regexp_extract(base, legacy, 3).try_cast("double")
    ok = F.regexp_like(base, F.lit(legacy)) & lvl.isNotNull()
    is_clean = base.contains("clean")
    first = F.regexp_extract(base, r"^([^_.]+)", 1)
    part = {k: _dir_value(path, k) for k in ("model", "task", "perturbation", "level")}
    has_parts = part["task"].isNotNull()
    model_legacy = F.when(parent == "metrics", F.lit("unknown")).otherwise(parent)
    return {
        "model": F.when(has_parts, part["model"]).otherwise(model_legacy),
        "task": F.when(has_parts, part["task"]).when(ok, F.regexp_extract(base, legacy, 1))
                 .when(is_clean, first),
        "perturbation": F.when(has_parts, part["perturbation"]).when(ok, F.regexp_extract(base, legacy, 2))
                         .when(is_clean, F.lit("clean")),
        "level": F.when(has_parts, part["level"].try_cast("double")).when(ok, lvl)
                  .when(is_clean, F.lit(0.0)),
    }


def report_long(reports: DataFrame) -> DataFrame:
    """Plot-ready rows: accuracy = perturbed accuracy (default 0), relative drop and consistency x 100."""
    meta = parse_report_path(F.col("file_path"))
    return (reports.select("file_path", *[v.alias(k) for k, v in meta.items()], "language", "acc_perturbed",
                           "rel_drop_acc",
                           "consistency")
            .filter(F.col("task").isNotNull() & ~F.col("file_path").rlike("config_snapshot|robustness_report|all_results"))
            .select("model", "task", "perturbation", "level", "language",
                    F.coalesce("acc_perturbed", F.lit(0.0)).alias("accuracy"),
                    (F.coalesce("rel_drop_acc", F.lit(0.0)) * 100.0).alias("rel_drop"),
                    (F.coalesce("consistency", F.lit(0.0)) * 100.0).alias("consistency")))


# ---- summaries and flip reports (A11, A12) ------------------------------------------------------

def write_summaries(report: DataFrame, path: str) -> str:
    """All that a roll-up leaves: means by model and by model and language, and the whole report flat as CSV and JSON."""
    from tremor.operators.reports import summary

    write_csv(summary(report, ["model"]), f"{path}/summary_overall_model")
    write_csv(summary(report, ["model", "language"]), f"{path}/summary_by_language")
    write_csv(report, f"{path}/all_results_flat")
    return write_jsonl(report, f"{path}/all_results") and path


# ---- CSV tables (A11) ------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**CSV_OPTS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_READ).csv(path)
