"""Scans of the input tables and the standardized task views built on them (A1, A2, B1, B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators.sampling import with_row_keys

EXAMPLE_COLUMNS = ["id", "language", "task", "split", "text", "premise", "hypothesis", "label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_present(df: DataFrame, names, default):
    for n in names:
        if n in df.columns:
            return F.col(n)
    return default


def standardize(df: DataFrame, task: str, task_type: str = "classification", split: str | None = None, row_keys: bool = False) -> DataFrame:
    """Map a raw task table to the standard example schema (B1/B2).

    With `row_keys`, a table without an id column gets stable keys (`sampling.with_row_keys`) where the default would
    be the one id '-1' for all rows, which can be neither split nor paired.

    Alternate source columns are chosen by presence: idx|id, text|sentence, premise|sentence1,
    hypothesis|sentence2. Defaults: id '-1', label '-1', language 'unknown', missing text ''.
    For pairs, a row whose resolved premise and hypothesis are both empty retries sentence1/sentence2.
    Source columns are dropped.
    """
    empty = F.lit("")
    cols = {
        "id": _first_present(df, ["idx", "id"], F.lit(-1)).cast("string"),
        "language": _first_present(df, ["language"], F.lit("unknown")).cast("string"),
        "task": F.lit(task),
        "split": (_first_present(df, ["split"], F.lit(split)) if split is not None
                  else _first_present(df, ["split"], F.lit("train"))).cast("string"),
        "label": F.coalesce(_first_present(df, ["label"], F.lit(-1)).cast("string"), F.lit("-1")),
    }
    if task_type == "classification":
        cols["text"] = _first_present(df, ["text", "sentence"], empty).cast("string")
        cols["premise"] = F.lit(None).cast("string")
        cols["hypothesis"] = F.lit(None).cast("string")
    else:
        p = _first_present(df, ["premise", "sentence1"], empty).cast("string")
        h = _first_present(df, ["hypothesis", "sentence2"], empty).cast("string")
        s1 = _first_present(df, ["sentence1"], empty).cast("string")
        s2 = _first_present(df, ["sentence2"], empty).cast("string")
        both_empty = (F.coalesce(p, empty) == "") & (F.coalesce(h, empty) == "")
        cols["text"] = F.lit(None).cast("string")
        cols["premise"] = F.when(both_empty, s1).otherwise(p)
        cols["hypothesis"] = F.when(both_empty, s2).otherwise(h)
    out = df.select(*[cols[c].alias(c) for c in EXAMPLE_COLUMNS])
    if row_keys and not {"idx", "id"} & set(df.columns):
        out = with_row_keys(out, "id")
    return out


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw classification task: documents (idx, text, label, language); the label is null where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("idx"), "text", F.col("quality").alias("label"), F.col("lang").alias("language"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of `raw_quality` as narrow rows (task, language, id, label), for documents dealt by these keys.

    Documents without a language are left out: no key equals theirs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").filter(F.col("lang").isNotNull()).distinct()
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # a literal task would be folded out of the join's keys, and the texts dealt a second time without it
    return docs.join(labels, "doc_id").select(
        F.explode(F.array(F.lit("quality"))).alias("task"), F.col("lang").cast("string").alias("language"),
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("label"))


def raw_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pair task: each user turn (premise) with the directly following assistant turn (hypothesis).

    Expressed as an equi-join on (conv_id, turn + 1) rather than a window over conv_id, so a very long
    conversation never lands in one task; label '1' iff the answer is longer than the question.
    """
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("premise"))
    nxt = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return user.join(nxt, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        "premise", "hypothesis",
        F.when(F.length("hypothesis") > F.length("premise"), F.lit(1)).otherwise(F.lit(0)).alias("label"))


def raw_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled text task: (item_id, text) -> no label, no language (defaults apply)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("sentence"))


def load_task(spark: SparkSession, path: str, task: str, task_type: str = "classification", fmt: str | None = None,
              schema: str | None = None, languages=None) -> DataFrame:
    """Any task of any name and type from files (A1): parquet, JSON lines or CSV, told by `fmt` or the path's ending.

    A folder may hold one file or folder per split (train, validation, test): a row without a split of its own takes
    it from there.  JSON and CSV want a `schema`; ids that are missing altogether become stable keys.  `languages`
    keeps rows of these only (a missing one counts as 'unknown').
    """
    fmt = fmt or next((f for e, f in ((".parquet", "parquet"), (".jsonl", "json"), (".json", "json"), (".csv", "csv")) if path.rstrip("/").endswith(e)), "parquet")
    if fmt != "parquet" and schema is None:
        raise ValueError("JSON and CSV files want a schema")
    r = spark.read.schema(schema) if schema else spark.read
    r = r.option("recursiveFileLookup", "true")
    raw = (r.options(header="true", quote='"', escape='"', multiLine="true").csv(path) if fmt == "csv" else r.format(fmt).load(path))
    if "split" not in raw.columns:
        found = F.regexp_extract(F.col("_metadata.file_path"), r"/(train|validation|test)[^/]*(?:/[^/]+)?$", 1)
        raw = raw.select("*", F.coalesce(F.nullif(found, F.lit("")), F.lit("train")).alias("split"))
    out = standardize(raw, task, task_type, row_keys=True)
    return out if languages is None else out.filter(F.coalesce("language", F.lit("unknown")).isin(list(languages)))


def scan_task(spark: SparkSession, sf_dir: str, task: str, drop_unlabeled: bool = False) -> DataFrame:
    """Load one named task, standardized (A1).

    A missing label becomes '-1' and is scored as an ordinary class, as the original does; `drop_unlabeled`
    removes those rows instead.
    """
    if task == "quality":
        out = standardize(raw_quality(spark, sf_dir), "quality", "classification")
    elif task == "dialog":
        out = standardize(raw_dialog(spark, sf_dir), "dialog", "nli")
    elif task == "benchmark":
        out = standardize(raw_benchmark(spark, sf_dir), "benchmark", "classification")
    else:
        raise ValueError(f"unknown task {task!r}")
    return out.filter(F.col("label") != "-1") if drop_unlabeled else out


def pick_split(df: DataFrame) -> DataFrame:
    """Evaluation split: 'validation' where present, else 'train' (A2), decided per task.

    Presence is one aggregate row per task, and a table holds one task (`scan_task` names it), so the broadcast is
    a row: a shuffle join on `task` would send everything to one reducer.  No collect to the driver.
    """
    has_val = (df.groupBy("task").agg(F.max((F.col("split") == "validation").cast("int")).alias("_hv")))
    return (df.join(F.broadcast(has_val), "task")
            .filter(F.col("split") == F.when(F.col("_hv") == 1, F.lit("validation")).otherwise(F.lit("train")))
            .drop("_hv"))
