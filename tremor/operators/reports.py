"""Error analysis and roll-up reports.

Inputs are the paired rows of `pairs.pair_join` or the per-group robustness report; outputs are flat tables.
Per-group samples use `sampling.first_per_group` (bounded per map task); roll-ups are plain grouped averages,
the bootstrap is a Poisson bootstrap with counter-based weights (no resampling through the driver).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import fixed, rng
from tremor.operators import sampling
from tremor.operators.pairs import fetched

GROUP = ["model", "task", "language", "perturbation", "level"]


def _differs(a: str, b: str):
    """pandas `!=`: true when either side is missing (NaN != NaN)."""
    return ~F.coalesce(F.col(a) == F.col(b), F.lit(False))


def flips(paired: DataFrame) -> DataFrame:
    return paired.filter(_differs("prediction_clean", "prediction_pert"))


def error_cases(paired: DataFrame, threshold: float = fixed.HIGH_CONF_THRESHOLD,
                per_group: int = fixed.ERROR_CASES_PER_GROUP, texts: DataFrame | None = None) -> DataFrame:
    """First `per_group` flips and confident failures per run group, in one heterogeneous table.

    One lineage: each paired row is tagged with the error types it matches (it may match both), then one
    bounded top-k per (group, type).  With `texts` (one row per example, see `pairs.fetched`) no text is read
    until the cases are chosen; without, `paired` brings its own.
    """
    flip = _differs("prediction_clean", "prediction_pert")
    high = _differs("prediction_pert", "label_pert") & (F.col("score_pert") > F.lit(float(threshold)))
    types = F.filter(F.array(F.when(flip, F.lit("prediction_flip")), F.when(high, F.lit("high_confidence_failure"))),
                     lambda t: t.isNotNull())
    tagged = paired.filter(flip | high).withColumn("type", F.explode(types))
    if texts is not None:
        tagged = tagged.drop("text_clean", "text_pert")
    top = sampling.first_per_group(tagged, [*GROUP, "type"], [F.col("id")], per_group)
    if texts is not None:
        top = fetched(top, texts)
    is_flip = F.col("type") == "prediction_flip"
    return top.select(
        "type", *GROUP, "id",
        F.when(is_flip, F.col("text_clean")).alias("text_clean"), F.col("text_pert").alias("text_perturbed"),
        F.when(is_flip, F.col("prediction_clean")).alias("pred_clean"),
        F.when(is_flip, F.col("prediction_pert")).alias("pred_perturbed"),
        F.when(is_flip, F.col("label_clean")).otherwise(F.col("label_pert")).alias("ground_truth"),
        F.when(~is_flip, F.col("prediction_pert")).alias("prediction"),
        F.when(~is_flip, F.col("score_pert")).alias("confidence"))


def flip_counts(paired: DataFrame, keys=GROUP, comparisons: DataFrame | None = None) -> DataFrame:
    """total_samples, flip_count, flip_rate (0.0 when empty) per group (F10); with `comparisons`, a comparison
    without overlapping ids reports zeros."""
    d = _differs("prediction_clean", "prediction_pert")
    st = paired.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_samples"), F.count_if(d).alias("flip_count"))
    if comparisons is not None:
        st = (comparisons.select(*keys).distinct().join(st, list(keys), "left")
              .na.fill(0, ["total_samples", "flip_count"]))
    return st.withColumn("flip_rate", F.when(F.col("total_samples") > 0,
                                             F.col("flip_count") / F.col("total_samples")).otherwise(0.0))


def sampled_flips(paired: DataFrame, n: int = fixed.ERROR_CASES_PER_GROUP, seed=fixed.DEFAULT_SEED,
                  keys=GROUP) -> DataFrame:
    """min(n, #flips) seeded flips per group: id, label, clean and perturbed prediction."""
    s = sampling.seeded_sample(flips(paired), keys, n, seed)
    return s.select(*keys, "id", F.col("label_clean").alias("label"),
                    F.col("prediction_clean").alias("clean_pred"), F.col("prediction_pert").alias("pert_pred"))


def flip_report(counts: DataFrame, sampled: DataFrame, keys=GROUP) -> DataFrame:
    """Flip counts per comparison with its sampled flips as one array, in the order of their draws.

    `counts` has one row per comparison (`metrics.stats_from_counts`), `sampled` a few rows each (`sampled_flips`).
    """
    k = F.struct(rng.draw(rng.row_key(fixed.DEFAULT_SEED, "sample", "id"), 0).alias("u"), "id", "label", "clean_pred", "pert_pred")
    few = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list(k)).alias("_s"))
    few = few.select(*keys, F.transform("_s", lambda s: F.struct(s["id"].alias("id"), s["label"].alias("label"), s["clean_pred"].alias("clean_pred"),
                                                                 s["pert_pred"].alias("pert_pred"))).alias("samples"))
    none = F.array().cast("array<struct<id:string,label:string,clean_pred:string,pert_pred:string>>")
    return (counts.select(*keys, "total_samples", F.col("flipped_count").alias("flip_count"), "flip_rate")
            .join(few, list(keys), "left").withColumn("samples", F.coalesce("samples", none)))


# ---- roll-ups of the robustness report --------------------------------------------------

ROLLUP = ["acc_clean", "acc_perturbed", "rel_drop_acc", "consistency"]


def summary(report: DataFrame, keys) -> DataFrame:
    """Unweighted means of the report columns per group; nulls skipped."""
    return report.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ROLLUP])


def summary_sets(report: DataFrame) -> DataFrame:
    """Per model and per (model, language) in one aggregate: GROUPING SETS ((model), (model, language))."""
    return (report.groupingSets([["model"], ["model", "language"]], "model", "language")
            .agg(F.grouping("language").cast("tinyint").alias("all_languages"), *[F.avg(c).alias(c) for c in ROLLUP]))


def drop_pivot(report: DataFrame, families) -> DataFrame:
    """Relative accuracy drop (x100) per (model, language), one column per perturbation family."""
    return (report.groupBy("model", "language").pivot("perturbation", list(families))
            .agg(F.avg(F.col("rel_drop_acc") * 100.0)))


def cross_lingual_gap(report: DataFrame, pivot_language: str = "en") -> DataFrame:
    """Each language's perturbed accuracy and relative drop minus those of the pivot language, same run."""
    keys = ["model", "task", "perturbation", "level"]
    ref = report.filter(F.col("language") == pivot_language).select(
        *keys, F.col("acc_perturbed").alias("_acc_ref"), F.col("rel_drop_acc").alias("_drop_ref"))
    return (report.join(ref, keys)
            .select(*keys, "language",
                    (F.col("acc_perturbed") - F.col("_acc_ref")).alias("acc_gap"),
                    (F.col("rel_drop_acc") - F.col("_drop_ref")).alias("rel_drop_gap")))


# ---- Poisson bootstrap ------------------------------------------------------------------

def poisson_thresholds(max_k: int = 12) -> list[int]:
    """Integer draw thresholds T_j = floor(P * CDF_Poisson(1)(j)); weight = #{j : draw >= T_j}."""
    out, cdf, term = [], 0.0, math.exp(-1.0)
    for j in range(max_k):
        cdf += term
        out.append(int(math.floor(min(cdf, 1.0) * rng.P)))
        term /= (j + 1)
    return out


def bootstrap_ci(df: DataFrame, keys, value: str, row_id, replicates: int = 1000, seed=fixed.DEFAULT_SEED,
                 alpha: float = 0.05) -> DataFrame:
    """Mean and (alpha/2, 1-alpha/2) percentile interval of `value` per group.

    Every row gets a Poisson(1) weight per replicate from u(seed, 'boot', row_id, b); replicate means are
    weighted sums with map-side partial aggregation; percentiles are over replicates (small per group).
    """
    k = rng.row_key(seed, "boot", row_id)
    x = df.select(*keys, F.col(value).cast("double").alias("_x"), k.alias("_k")) \
        .withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))))
    d = rng.draw(F.col("_k"), F.col("_b"))
    w = sum((d >= F.lit(t)).cast("int") for t in poisson_thresholds())
    reps = (x.withColumn("_w", w)
            .groupBy(*keys, "_b")
            .agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")),
                              F.sum(F.when(F.col("_x").isNotNull(), F.col("_w")))).alias("_m")))
    lo, hi = alpha / 2, 1 - alpha / 2
    ci = reps.groupBy(*keys).agg(F.percentile("_m", lo).alias("ci_low"), F.percentile("_m", hi).alias("ci_high"))
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.col(value)).alias("n"))
    return mean.join(ci, list(keys), "left")


def report_from_runs(runs: DataFrame, keys=("model", "task", "perturbation", "level", "language")) -> DataFrame:
    """Robustness report from a stored prediction table (the post-hoc path): per-run metrics merged over the
    union of languages (`metrics.outer_metrics`) plus consistency over the id-joined pairs; n = paired ids."""
    from tremor.operators import metrics as M
    from tremor.operators import pairs as PR

    keys = list(keys)
    out = M.outer_metrics(M.classification_metrics(runs, keys))
    cons = PR.comparison_counts(runs).filter("n_matched > 0")
    return (out.join(cons.select(*keys, (F.col("n_agree") / F.col("n_matched")).alias("consistency"), F.col("n_matched").alias("n")), keys, "left")
            .select(*keys, *M.SUMMARY_COLUMNS, "n"))
