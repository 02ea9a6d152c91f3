"""The experiment's outcome materialized once in the shared folder (a written table cuts lineage).

Post-hoc analyses (pairing, flips, consistency, error cases) read this table, as the original reads stored
prediction files; the write is durable, so a lost executor never forces perturbing and scoring to be repeated.

One row per example: its predictions (`cells`, narrow) and its texts under every grid row, once, whatever the number
of models.  The table is bucketed by (task, language, id): the raw examples are dealt to the buckets before they are
perturbed, so no perturbed text is ever shuffled, and pairing by id or fetching the texts of a few rows needs no
exchange.  A file holds one bucket, so their number is the number of buckets.  Where no text is asked for none is
written: metrics and roll-ups store the predictions only, and take the whole table's where that is there already.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import one_pass as OP
from tremor.plans import views as V
from tremor.session import scratch_path, unsorted_writes

BUCKET_KEYS = ["task", "language", "id"]
SOURCES = ("documents", "labels", "conversations", "benchmark")

#: How the table's pages are written: the eight texts of an example lie side by side in a page, where zstd finds most
#: of one in another.  Its first level packs them as small as the third and as fast as snappy, which leaves twice as much.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}

_examples: dict[tuple, tuple] = {}
_narrow: dict[tuple, tuple] = {}
_reports: dict[tuple, tuple] = {}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Size and time of change of the input tables: what is stored for other tables is out of date."""
    out = []
    for name in SOURCES:
        fs, p = _file_system(spark, f"{sf_dir}/{name}.parquet")
        out.append((fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def write_examples(spark: SparkSession, examples: DataFrame, grid, predictors, path: str, buckets: int | None = None, perturber=None,
                   with_text: bool = True) -> str:
    """The crossing's rows as a bucketed table at `path`; its name.  `examples` are dealt to the buckets already.

    A task holds one bucket, so rows are written as they come: a sort by bucket would spill every perturbed text.
    """
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tremor_examples_{uuid.uuid4().hex[:12]}"
    x = OP.crossed(examples, grid, predictors, perturber, with_text=with_text)
    with unsorted_writes(spark):
        x.write.bucketBy(n, *BUCKET_KEYS).options(**PACKED).option("path", path).format("parquet").saveAsTable(name)
    return name


def stored_examples(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """The table of this application for `sf_dir`, written at first use and again when its input has changed; without
    `text` one that may lack the texts."""
    key, now = (spark.sparkContext.applicationId, sf_dir), stamp(spark, sf_dir)
    if any(key in kept and kept[key][0] != now for kept in (_examples, _narrow)):
        forget(spark, sf_dir)
    kept = _examples if text or key in _examples else _narrow
    if key not in kept:
        path = scratch_path(spark, "examples" if text else "predictions")
        examples = V.dealt_examples(spark, sf_dir, BUCKET_KEYS)
        kept[key] = (now, write_examples(spark, examples, V.grid_list(), V.rule_models(), path, with_text=text), path)
    return spark.table(kept[key][1])


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Remove what is stored for `sf_dir`: the tables and their files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    for kept in (_examples, _narrow):
        if key in kept:
            _, name, path = kept.pop(key)
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            _remove(spark, path)
    if key in _reports:
        _remove(spark, _reports.pop(key)[1])


def runs_of(x: DataFrame, grid, predictors, text: bool = True) -> DataFrame:
    """The long run table as a view of the stored examples; a query that reads no text reads none from the files."""
    out = OP.long_rows(x, grid, predictors, text=text)
    return out.select(*V.RUN_KEYS, "id", *([V.stored_text(F.col("fields")).alias("text")] if text else []), "label", "prediction", "score")


def stored_runs(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Every stored prediction: model, task, perturbation, level, language, id, text (if asked for), label, prediction,
    score."""
    return runs_of(stored_examples(spark, sf_dir, text), V.grid_list(), V.rule_models(), text)


def stored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, language, id, texts) with texts an array of (perturbation, level, text): one row per example."""
    rows = [OP.CLEAN, *V.grid_list()]
    items = F.array(*[F.struct(F.lit(p).alias("perturbation"), F.lit(lv).alias("level"), V.stored_text(F.get("texts", F.lit(g))).alias("text"))
                      for g, (p, lv) in enumerate(rows)])
    return stored_examples(spark, sf_dir).select(*BUCKET_KEYS, items.alias("texts"))


REPORT_SCHEMA = ("model string, task string, perturbation string, level double, language string, "
                 "acc_clean double, acc_perturbed double, abs_drop_acc double, rel_drop_acc double, f1_clean double, "
                 "f1_perturbed double, abs_drop_f1 double, rel_drop_f1 double, consistency double, n long")


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robustness report (one row per model/task/perturbation/level/language), computed from the stored
    predictions (no second perturbation pass) and written once under the shared folder; roll-ups read it as the
    original reads its report files.  Its values equal the fast path's (`experiment`)."""
    from tremor.operators.reports import report_from_runs

    key, now = (spark.sparkContext.applicationId, sf_dir), stamp(spark, sf_dir)
    if key not in _reports or _reports[key][0] != now:
        report = report_from_runs(stored_runs(spark, sf_dir, text=False))  # (this may forget an outdated report)
        path = scratch_path(spark, "report")
        report.write.mode("overwrite").parquet(path)
        _reports[key] = (now, path)
    return spark.read.schema(REPORT_SCHEMA).parquet(_reports[key][1])
