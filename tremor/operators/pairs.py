"""Pairing of clean and perturbed runs (C3-C6, C9, C10, F4, F7-F10) over a long `runs` table.

Nothing is joined.  The rows of one (model, task, language, id) are put in order, the clean one first, and every
perturbed row takes the clean row's values from the head of its group: one exchange of narrow rows, none where the
table is bucketed by (task, language, id), and a text only where a query asks for one.  Two rows of one run and id
are neighbours in that order, so a duplicate id is seen and fails the query.  Groups are as long as the grid; rows
without an id match nothing and are spread by a number of their own, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.config import config_table

PAIR_KEYS = ["model", "task", "language"]
ROW_COLS = ["text", "label", "prediction", "score"]
RUN = ["perturbation", "level"]


def clean_side(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("perturbation") == "clean")


def perturbed_side(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("perturbation") != "clean")


def run_pairs(runs: DataFrame) -> DataFrame:
    """(model, task, language) groups having a clean run, each paired with every perturbed run.

    One aggregate lists the runs; a window over these few rows says which groups have a clean one.
    """
    listed = runs.groupBy(*PAIR_KEYS, *RUN).agg(F.count(F.lit(1)).alias("_n"))
    return _with_clean(listed, F.lit(True)).filter("_has").select(*PAIR_KEYS, *RUN)


def _with_clean(per_run: DataFrame, value: Column) -> DataFrame:
    """Perturbed runs of a table with one row per run, with `_has`: `value` of the group's clean run, else null."""
    noisy = F.col("perturbation") != "clean"
    known = [F.col(k).isNotNull() for k in PAIR_KEYS]
    ok = known[0] & known[1] & known[2]
    has = F.max(F.when(~noisy & ok, value)).over(Window.partitionBy(*PAIR_KEYS))
    return per_run.withColumn("_has", has).filter(noisy)


def with_clean(runs: DataFrame, check_unique: bool = True) -> DataFrame:
    """Every run row with `_noisy`, `_first` (no earlier row of its run and id), `_matched` (its id has a clean row)
    and the clean row's values as `<column>_clean`."""
    cols = [c for c in ROW_COLS if c in runs.columns]
    keys = [*PAIR_KEYS, "id"]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    x = runs.filter(F.col("perturbation").isNotNull()).withColumn("_noisy", F.col("perturbation") != "clean")
    x = x.withColumn("_own", F.when(~known, F.monotonically_increasing_id()))
    w = Window.partitionBy(*keys, "_own").orderBy("_noisy", *RUN)
    head = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clean_before = F.count_if(~F.col("_noisy")).over(head)
    again = F.coalesce((F.lag("perturbation").over(w) == F.col("perturbation")) & F.lag("level").over(w).eqNullSafe(F.col("level")), F.lit(False))
    x = x.withColumns({"_again": again, "_matched": clean_before > 0, "_twice": clean_before > 1, **{f"{c}_clean": F.first(c).over(head) for c in cols}})
    if check_unique:
        # rides on a group key, which every analysis reads; a clean duplicate also fails at the perturbed rows
        guard = F.when(F.col("_again") | F.col("_twice"), F.raise_error(F.concat(F.lit("duplicate id in a run: "), F.col("id"))).cast("string"))
        x = x.withColumn("perturbation", guard.otherwise(F.col("perturbation")))
    return x.withColumn("_first", ~F.col("_again")).withColumn("_matched", F.col("_matched") & F.col("_own").isNull()).drop("_again", "_twice", "_own")


def pair_join(runs: DataFrame, check_unique: bool = True) -> DataFrame:
    """Clean and perturbed predictions of the same id side by side, suffixes _clean/_pert (C4)."""
    cols = [c for c in ROW_COLS if c in runs.columns]
    x = with_clean(runs, check_unique).filter(F.col("_noisy") & F.col("_matched"))
    return x.select(*PAIR_KEYS, "id", *[f"{c}_clean" for c in cols], *RUN, *[F.col(c).alias(f"{c}_pert") for c in cols])


def comparison_counts(runs: DataFrame, check_unique: bool = True) -> DataFrame:
    """Per comparison (model, task, language, perturbation, level) with a clean run: n_matched, n_clean_only,
    n_pert_only, n_same (equal predictions, a missing one equals nothing) and n_agree (two missing ones agree).

    One scan: the pairing, one aggregate per run (clean runs included), and a window over the resulting few rows.  A
    comparison whose runs share no id has its row, with zeros.
    """
    same = F.coalesce(F.col("prediction_clean") == F.col("prediction"), F.lit(False))
    agree = F.col("prediction_clean").eqNullSafe(F.col("prediction"))
    one = F.col("_first")
    x = with_clean(runs, check_unique).groupBy(*PAIR_KEYS, *RUN).agg(
        F.count_if(one & F.col("id").isNotNull()).alias("_ids"), F.count_if(one & F.col("_matched")).alias("n_matched"),
        F.count_if(one & ~F.col("_matched")).alias("n_pert_only"), F.count_if(F.col("_matched") & same).alias("n_same"),
        F.count_if(F.col("_matched") & agree).alias("n_agree"))
    return (_with_clean(x, F.col("_ids")).filter("_has is not null")
            .select(*PAIR_KEYS, *RUN, "n_matched", (F.col("_has") - F.col("n_matched")).alias("n_clean_only"), "n_pert_only", "n_same", "n_agree"))


def coverage(runs: DataFrame) -> DataFrame:
    """Per comparison: ids on both sides, only clean, only perturbed; an id counts once."""
    return comparison_counts(runs, check_unique=False).select(*PAIR_KEYS, *RUN, "n_matched", "n_clean_only", "n_pert_only")


def fetched(rows: DataFrame, texts: DataFrame, clean: str = "text_clean", pert: str = "text_pert", every: bool = False) -> DataFrame:
    """`rows` (task, language, id, perturbation, level, ...) with the clean and the perturbed text of each.

    `texts` has one row per example: task, language, id and an array of (perturbation, level, text).  It must hold
    the examples of `rows` (an inner join: cut down first, the rows are the side that is broadcast, and the texts are
    read past it without a sort or an exchange).
    """
    def pick(match) -> Column:
        return F.get(F.filter("texts", match), F.lit(0))["text"]

    return ((rows.hint("shuffle_hash") if every else rows).join(texts, ["task", "language", "id"])
            .withColumns({clean: pick(lambda t: t["perturbation"] == "clean"),
                          pert: pick(lambda t: (t["perturbation"] == F.col("perturbation")) & t["level"].eqNullSafe(F.col("level")))})
            .drop("texts"))


def label_map_table(spark, rows) -> DataFrame:
    """(model, raw, label) rows from configuration."""
    return config_table(spark, rows, "model string, raw string, label string")


def map_labels(df: DataFrame, label_map: DataFrame, model_col: str = "model", raw: str = "prediction") -> DataFrame:
    """Model label -> dataset label through a (model, raw, label) table; unknown raw labels pass through.

    The map has one row per (model, label) and is built by `label_map_table`, which checks its size and
    marks it for broadcast: joined on (model, raw label), a shuffle join would put every row of one hot
    model/label pair into one task.
    """
    m = label_map.select(F.col("model").alias(model_col), F.col("raw").alias("_raw"), F.col("label").alias("_mapped"))
    return (df.join(m, (df[model_col] == m[model_col]) & (df[raw] == m["_raw"]), "left")
            .drop(m[model_col])
            .withColumn(raw, F.coalesce(F.col("_mapped"), F.col(raw))).drop("_raw", "_mapped"))
