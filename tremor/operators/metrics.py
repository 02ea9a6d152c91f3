"""Classification and robustness metrics as grouped aggregates.

Every metric is computed from a *count table* (group keys x label x prediction[s] -> n), produced
by one partially aggregated shuffle; all later steps run on that tiny table.  So a group holding
a third of all rows costs no more than any other: map-side combine shrinks it before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _eq_null_safe(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def counts(df: DataFrame, keys, *cols) -> DataFrame:
    """(keys, cols...) -> n.  The only shuffle of every metric in this module."""
    return df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("n"))


def accuracy_from_counts(cnt: DataFrame, keys, label: str, pred: str, name: str = "accuracy") -> DataFrame:
    return cnt.groupBy(*keys).agg(
        (F.sum(F.when(_eq_null_safe(label, pred), F.col("n")).otherwise(0)) / F.sum("n")).alias(name))


def f1_from_counts(cnt: DataFrame, keys, label: str, pred: str, name: str = "f1_macro") -> DataFrame:
    """Macro F1 over the union of true and predicted classes, zero_division = 0.

    Each count row contributes (class=label: tp, support) and (class=pred: predicted); per class
    F1 = 2 tp / (support + predicted); the mean over classes is the macro F1.
    """
    side = F.explode(F.array(
        F.struct(F.col(label).alias("cls"),
                 F.when(_eq_null_safe(label, pred), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"))))
    per_class = (cnt.select(*keys, side.alias("c")).select(*keys, "c.*")
                 .groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"),
                                            F.sum("prd").alias("prd")))
    f1 = F.when(F.col("sup") + F.col("prd") > 0,
                2.0 * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(0.0)
    return per_class.groupBy(*keys).agg(F.avg(f1).alias(name))


def _class_rows(label: str, pred: str, side: str | None = None, extra: dict | None = None) -> list:
    """Per-class contributions of one count row: (class=label: tp, support) and (class=pred: predicted)."""
    tag = [] if side is None else [F.lit(side).alias("side")]
    ex = extra or {}
    on_label = F.struct(*tag, F.col(label).alias("cls"),
                        F.when(_eq_null_safe(label, pred), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                        *[v.alias(k) for k, v in ex.items()])
    on_pred = F.struct(*tag, F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                       F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                       *[F.lit(0).cast("bigint").alias(k) for k in ex])
    return [on_label, on_pred]


def _f1_class():
    return F.when(F.col("sup") + F.col("prd") > 0, 2.0 * F.col("tp") / (F.col("sup") + F.col("prd"))).otherwise(0.0)


def classification_metrics(df: DataFrame, keys, label: str = "label", pred: str = "prediction") -> DataFrame:
    """accuracy, f1_macro, n per group (F1, F2) in one lineage: counts -> per-class rows -> per group.

    No branch re-reads the input, so an expensive upstream (perturbation, scoring) runs exactly once.
    """
    cnt = counts(df, keys, label, pred)
    per_class = (cnt.select(*keys, F.explode(F.array(*_class_rows(label, pred))).alias("c"))
                 .select(*keys, "c.*")
                 .groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"),
                                            F.sum("prd").alias("prd")))
    return per_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("sup")).alias("accuracy"), F.avg(_f1_class()).alias("f1_macro"),
        F.sum("sup").alias("n"))


def all_metrics(df: DataFrame, keys, label: str = "label", pred: str = "prediction") -> DataFrame:
    """accuracy, f1_macro, n, classes and cells (true_label, pred_label, n; zeros filled) per group.

    One shuffle sees the data (the counts); one more gathers a group's counts, at most classes^2 of them, and
    everything is computed from that array.  Classes are sorted; a null label or prediction is a class of its own
    (the first), so every row is in some cell.
    """
    keys = list(keys)
    cnt = counts(df, keys, label, pred)
    found = F.collect_list(F.struct(F.col(label).alias("t"), F.col(pred).alias("p"), "n"))
    x = cnt.groupBy(*keys).agg(found.alias("_c"))
    both = F.array_distinct(F.concat(F.transform("_c", lambda c: c["t"]), F.transform("_c", lambda c: c["p"])))
    x = x.withColumn("classes", F.sort_array(both))

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda s, c: s + c["n"])

    def of(t: Column | None, p: Column | None) -> Column:
        def hit(c):
            a = F.lit(True) if t is None else c["t"].eqNullSafe(t)
            return a if p is None else a & c["p"].eqNullSafe(p)
        return total(F.filter("_c", hit))

    # the rows of one true class first: a cell looks through these only
    per_class = F.transform("classes", lambda t: F.struct(t.alias("t"), F.filter("_c", lambda c: c["t"].eqNullSafe(t)).alias("own")))
    cells = F.flatten(F.transform(per_class, lambda r: F.transform("classes", lambda p: F.struct(
        r["t"].alias("true_label"), p.alias("pred_label"), total(F.filter(r["own"], lambda c: c["p"].eqNullSafe(p))).alias("n")))))
    f1 = F.transform("classes", lambda k: 2.0 * of(k, k) / (of(k, None) + of(None, k)))
    n = total(F.col("_c"))
    return x.select(
        *keys, (total(F.filter("_c", lambda c: c["t"].eqNullSafe(c["p"]))) / n).alias("accuracy"),
        (F.aggregate(f1, F.lit(0.0), lambda s, v: s + v) / F.size("classes")).alias("f1_macro"), n.alias("n"), "classes", cells.alias("cells"))


def confusion(df: DataFrame, keys, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Confusion counts over the union of classes of each group, zeros filled, one row per cell."""
    return all_metrics(df, keys, label, pred).select(*keys, F.inline("cells"))


def with_matrix(met: DataFrame, keys) -> DataFrame:
    """Metrics as they are stored: the classes in order and the confusion matrix, row by row, as JSON texts."""
    size = F.size("classes")
    rows = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.slice("cells", i * size + 1, size), lambda c: c["n"]))
    return (met.withColumn("confusion_matrix", F.to_json(rows)).withColumn("classes", F.to_json("classes"))
            .select(*keys, "accuracy", "f1_macro", "n", "classes", "confusion_matrix"))


def consistency(df: DataFrame, keys, a: str = "pred_clean", b: str = "pred_pert") -> DataFrame:
    """Share of equal prediction pairs, null == null counted as agreement (list rule, F4)."""
    return df.groupBy(*keys).agg(
        F.avg(_eq_null_safe(a, b).cast("double")).alias("consistency"),
        F.count(F.lit(1)).alias("n_pairs"))


def flip_stats(df: DataFrame, keys, a: str = "prediction_clean", b: str = "prediction_pert",
               comparisons: DataFrame | None = None) -> DataFrame:
    """total, consistent, flipped, consistency, flip_rate; two nulls are a flip (stored-table rule, F7).

    With `comparisons` (one row per clean/perturbed pair of runs, configuration-sized), a comparison whose
    runs share no id still gets a row: all counts 0, consistency 0.0 and flip rate 0.0.
    """
    same = F.coalesce(F.col(a) == F.col(b), F.lit(False))
    st = (df.groupBy(*keys)
          .agg(F.count(F.lit(1)).alias("total_samples"),
               F.count_if(same).alias("consistent_count"),
               F.count_if(~same).alias("flipped_count"))
          .withColumn("consistency", F.col("consistent_count") / F.col("total_samples"))
          .withColumn("flip_rate", F.lit(1.0) - F.col("consistency")))
    if comparisons is None:
        return st
    return (comparisons.select(*keys).distinct().join(st, list(keys), "left")
            .na.fill(0, ["total_samples", "consistent_count", "flipped_count"])
            .na.fill(0.0, ["consistency", "flip_rate"]))


def stats_from_counts(cmp: DataFrame, keys=None) -> DataFrame:
    """The statistics of `flip_stats` from `pairs.comparison_counts`, per comparison or summed over `keys`."""
    group = ["model", "task", "language", "perturbation", "level"] if keys is None else list(keys)
    if keys is not None:
        cmp = cmp.groupBy(*keys).agg(F.sum("n_matched").alias("n_matched"), F.sum("n_same").alias("n_same"))
    total, same = F.col("n_matched"), F.col("n_same")
    share = F.when(total > 0, same / total).otherwise(0.0)
    return cmp.select(*group, total.alias("total_samples"), same.alias("consistent_count"), (total - same).alias("flipped_count"),
                      share.alias("consistency"), F.when(total > 0, F.lit(1.0) - share).otherwise(0.0).alias("flip_rate"))


def robustness_columns(acc_c="acc_clean", acc_p="acc_perturbed", f1_c="f1_clean", f1_p="f1_perturbed") -> dict:
    """Absolute and relative drops; relative drop is 0.0 when the clean value is not positive."""
    def rel(c, p):
        return F.when(F.col(c) > 0, (F.col(c) - F.col(p)) / F.col(c)).otherwise(F.lit(0.0))
    return {
        "abs_drop_acc": F.col(acc_c) - F.col(acc_p),
        "rel_drop_acc": rel(acc_c, acc_p),
        "abs_drop_f1": F.col(f1_c) - F.col(f1_p),
        "rel_drop_f1": rel(f1_c, f1_p),
    }


SUMMARY_COLUMNS = ["acc_clean", "acc_perturbed", "abs_drop_acc", "rel_drop_acc",
                   "f1_clean", "f1_perturbed", "abs_drop_f1", "rel_drop_f1", "consistency"]


def paired_report(paired: DataFrame, keys) -> DataFrame:
    """Robustness summary per group from the paired table (fast path, F19-F21).

    One lineage, no branches: (keys, label, pred_clean, pred_pert) counts -> per side and class contributions
    -> per (side, class) sums -> per group.  The first aggregate is the only shuffle whose input grows with
    the data (partially aggregated map-side); the later ones see at most groups x 2 x classes rows.
    """
    cnt = counts(paired, keys, "label", "pred_clean", "pred_pert")
    agree = {"agree": F.when(_eq_null_safe("pred_clean", "pred_pert"), F.col("n")).otherwise(0)}
    rows = (_class_rows("label", "pred_clean", "clean", agree)
            + _class_rows("label", "pred_pert", "pert", {"agree": F.lit(0).cast("bigint")}))
    per_class = (cnt.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")
                 .groupBy(*keys, "side", "cls")
                 .agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("prd").alias("prd"),
                      F.sum("agree").alias("agree")))
    clean, pert = F.col("side") == "clean", F.col("side") == "pert"
    rep = per_class.groupBy(*keys).agg(
        (F.sum(F.when(clean, F.col("tp"))) / F.sum(F.when(clean, F.col("sup")))).alias("acc_clean"),
        (F.sum(F.when(pert, F.col("tp"))) / F.sum(F.when(pert, F.col("sup")))).alias("acc_perturbed"),
        F.avg(F.when(clean, _f1_class())).alias("f1_clean"),
        F.avg(F.when(pert, _f1_class())).alias("f1_perturbed"),
        (F.sum("agree") / F.sum(F.when(clean, F.col("sup")))).alias("consistency"),
        F.sum(F.when(clean, F.col("sup"))).alias("n"))
    return rep.withColumns(robustness_columns()).select(*keys, *SUMMARY_COLUMNS, "n")


def outer_metrics(met: DataFrame, keys=("model", "task", "perturbation", "level", "language"),
                  clean_value: str = "clean") -> DataFrame:
    """Clean and perturbed metrics of each run over the union of their language keys (C6), one lineage.

    `met` holds one row per (model, task, perturbation, level, language) with accuracy and f1_macro, clean runs
    included.  A window over (model, task) on this small table lists the perturbed runs of the group; each clean
    row is replicated to every such run, each perturbed row stays itself, and one aggregate per run and language
    merges the two sides; a side that is missing counts as 0.0.
    """
    model, task, pert, level, lang = keys
    is_clean = F.col(pert) == clean_value
    run = F.struct(F.col(pert).alias("p"), F.col(level).alias("l"))
    runs_of_group = F.array_distinct(F.collect_list(F.when(~is_clean, run)).over(Window.partitionBy(model, task)))
    x = met.withColumn("_runs", runs_of_group).withColumn(
        "_to", F.explode(F.when(is_clean, F.col("_runs")).otherwise(F.array(run))))
    side = lambda c, s: F.max(F.when(is_clean == s, F.col(c)))
    return (x.groupBy(model, task, F.col("_to.p").alias(pert), F.col("_to.l").alias(level), lang)
            .agg(F.coalesce(side("accuracy", True), F.lit(0.0)).alias("acc_clean"),
                 F.coalesce(side("f1_macro", True), F.lit(0.0)).alias("f1_clean"),
                 F.coalesce(side("accuracy", False), F.lit(0.0)).alias("acc_perturbed"),
                 F.coalesce(side("f1_macro", False), F.lit(0.0)).alias("f1_perturbed"))
            .withColumns(robustness_columns()))


def outer_summary(clean: DataFrame, pert: DataFrame, keys, consistency_df: DataFrame | None = None) -> DataFrame:
    """Union of the language keys of clean and perturbed metrics; a missing side counts as 0.0 (C6 + F5)."""
    c = clean.select(*keys, F.col("accuracy").alias("acc_clean"), F.col("f1_macro").alias("f1_clean"))
    p = pert.select(*keys, F.col("accuracy").alias("acc_perturbed"), F.col("f1_macro").alias("f1_perturbed"))
    j = c.join(p, list(keys), "full_outer").na.fill(0.0, ["acc_clean", "f1_clean", "acc_perturbed", "f1_perturbed"])
    if consistency_df is not None:
        j = j.join(consistency_df.select(*keys, "consistency"), list(keys), "left")
    else:
        j = j.withColumn("consistency", F.lit(None).cast("double"))
    return j.withColumns(robustness_columns())
