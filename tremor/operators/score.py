"""Model scoring surface.

* rule model (E3a): stop-word statistics from one Python split per text (fused with the perturbation
  kernel on the perturbed side), thresholds as JVM expressions per model;
* naive Bayes (E3b): token counts of the train split as the model table, scoring as a token join;
* plug-in predictor (E1/E2): any `list[str] -> list[(label, score)]` factory, run in an iterator Arrow
  UDF so the model is loaded once per Python worker and fed Arrow batches;
* raw-output helpers: top-1 of `array<struct<label, score>>` (E4) and input routing (E5).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import fixed
from tremor.functions.kernels import StopWords
from tremor.operators.config import config_table

#: Classes a fitted model may have (each is a column of its table).
CLASSES = 1000
RAW_OUTPUT = "array<struct<label:string,score:double>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rule_stats(text, words=None) -> dict[str, Column]:
    """Stop-word hits and token count of a text (tokens: lower-cased, split on single spaces, '.,' trimmed).

    Computed in an Arrow UDF: a JVM regex over every token costs more than a Python split, and on the perturbed
    side the text is already in Python (see `perturb.perturb_score_udf`), so both sides share one kernel.
    """
    from tremor.operators.perturb import stats_udf

    none = F.lit(None).cast("string")
    s = stats_udf(words)(none, none, _col(text))
    return {"n_tokens": s["n_tokens"], "n_hits": s["n_hits"]}


def rule_predict(hits, tokens, threshold) -> tuple[Column, Column]:
    """label '1' iff stop-word share >= threshold; score = share, or 1 - share for label '0'."""
    share = _col(hits).cast("double") / _col(tokens).cast("double")
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.when(share >= th, F.lit("1")).otherwise(F.lit("0"))
    score = F.when(share >= th, share).otherwise(F.lit(1.0) - share)
    return pred, score


DEFAULT_MODELS = [("stopword-t20", 0.2), ("stopword-t30", 0.3)]


def models_table(spark, models=None) -> DataFrame:
    """Grid of rule models (model, threshold) from a config list."""
    return config_table(spark, models if models is not None else DEFAULT_MODELS, "model string, threshold double")


def default_models(spark) -> DataFrame:
    return models_table(spark)


def score_stats(x: DataFrame, models: DataFrame, hits: str, tokens: str, prefix: str = "") -> DataFrame:
    """Apply every model threshold to precomputed statistics (`models_table` marks the grid for broadcast)."""
    x = x.crossJoin(models)
    pred, score = rule_predict(hits, tokens, F.col("threshold"))
    return x.withColumns({f"{prefix}prediction": pred, f"{prefix}score": score}).drop("threshold")


# ---- raw model output ----------------------------------------------------------

def top1(raw) -> tuple[Column, Column]:
    """Top-1 (label, score) of array<struct<label, score>>; ties broken by the smaller label; missing score 0.0."""
    r = _col(raw)
    best = F.aggregate(
        r, F.lit(None).cast("struct<label:string,score:double>"),
        lambda acc, x: F.when(
            acc.isNull()
            | (F.coalesce(x["score"], F.lit(0.0)) > F.coalesce(acc["score"], F.lit(0.0)))
            | ((F.coalesce(x["score"], F.lit(0.0)) == F.coalesce(acc["score"], F.lit(0.0)))
               & (x["label"] < acc["label"])), x).otherwise(acc))
    return best["label"], F.coalesce(best["score"], F.lit(0.0))


def route_input(df: DataFrame) -> DataFrame:
    """Pair input when both premise and hypothesis exist, else text (default ''); id default ''."""
    has_pair = F.col("premise").isNotNull() & F.col("hypothesis").isNotNull()
    return df.withColumns({
        "input_kind": F.when(has_pair, F.lit("pair")).otherwise(F.lit("text")),
        "input": F.when(has_pair, F.concat_ws(" ", "premise", "hypothesis"))
                  .otherwise(F.coalesce(F.col("text"), F.lit(""))),
        "id": F.coalesce(F.col("id"), F.lit("")),
    })


# ---- plug-in predictor ------------------------------------------------------------

def predictor_udf(factory: Callable[[], Callable[[list], list]], batch_size: int = 32):
    """Iterator Arrow UDF around a user predictor, which a worker process loads once (see `one_pass.loaded`).

    The predictor maps a list of input strings to a list of (label, score); order is preserved within
    each batch and the id travels with the row, so no positional pairing is needed downstream.
    """
    from tremor.operators.one_pass import Predictor, loaded

    model = Predictor("", factory, batch_size)

    @F.pandas_udf("label string, score double")
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            labels, scores = loaded(model)(s.fillna("").tolist())
            yield pd.DataFrame({"label": labels, "score": scores})

    return _score


def score_plugin(df: DataFrame, factory, model_name: str, text="input", batch_size: int = 32) -> DataFrame:
    out = predictor_udf(factory, batch_size)(_col(text))
    return df.withColumns({"model": F.lit(model_name), "prediction": out["label"], "score": out["score"]})


def stopword_predictor_factory(threshold: float = 0.2):
    """A pure-Python predictor with the rule model's semantics, for exercising the plug-in path."""

    def factory():
        words = StopWords(fixed.RULE_STOPWORDS)

        def predict(texts):
            res = []
            for n, hits in zip(*words.counts(texts), strict=True):
                share = hits / n
                res.append(("1", share) if share >= threshold else ("0", 1.0 - share))
            return res

        return predict

    return factory


# ---- model fitted by aggregates ----------------------------------------------------

@dataclass(frozen=True)
class NaiveBayes:
    """Multinomial naive Bayes as a table: one row per token with its log-likelihood under every class."""

    tokens: DataFrame
    classes: list[str]
    prior: list[float]
    unseen: list[float]


def _token_rows(df: DataFrame, keys, text: str) -> DataFrame:
    return df.select(*keys, F.explode(F.filter(F.split(F.lower(F.col(text)), " "), lambda w: w != "")).alias("_token"))


def fit_naive_bayes(train: DataFrame, path: str, text: str = "input", label: str = "label", alpha: float = 1.0) -> NaiveBayes:
    """Token counts per class in one shuffle, written to `path`; only class totals reach the driver.

    Rows without a label are left out.  Tokens are the lower-cased words between spaces; a count gets `alpha` added.
    """
    spark = train.sparkSession
    train = train.filter(F.col(label).isNotNull())
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().limit(CLASSES + 1).collect()}
    if not 0 < len(sizes) <= CLASSES:
        raise ValueError(f"{len(sizes)} classes: a classifier needs one, and at most {CLASSES}")
    classes = sorted(sizes)
    counts = _token_rows(train, [label], text).groupBy("_token").agg(
        *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(classes)])
    counts.write.mode("overwrite").parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    r = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(classes))]).first()
    size = [(r[f"n{i}"] or 0) + alpha * max(r["v"], 1) for i in range(len(classes))]
    weights = [F.log((F.col(f"n{i}") + F.lit(alpha)) / F.lit(size[i])).alias(f"w{i}") for i in range(len(classes))]
    n = sum(sizes.values())
    return NaiveBayes(counts.select("_token", *weights), classes, [math.log(sizes[c] / n) for c in classes], [math.log(alpha / s) for s in size])


def score_naive_bayes(df: DataFrame, model: NaiveBayes, model_name: str = "naive-bayes", text: str = "input", key: str = "id") -> DataFrame:
    """`df` with model, prediction and score, the class of greatest posterior and that posterior (ties: the first).

    A row's tokens are counted, joined to the token table and summed per class; `key` must be unique.  The token
    table has one row per token, so a token that a third of all words are skews the join on one side only, where
    adaptive execution splits it (and the counts per row shrink it first).  A text without tokens has the priors.
    """
    k = len(model.classes)
    words = _token_rows(df, [key], text).groupBy(key, "_token").agg(F.count(F.lit(1)).alias("_n"))
    hits = words.join(model.tokens, "_token", "left")
    sums = hits.groupBy(key).agg(*[F.sum(F.col("_n") * F.coalesce(f"w{i}", F.lit(model.unseen[i]))).alias(f"_s{i}") for i in range(k)])
    x = df.join(sums, key, "left").withColumns({f"_s{i}": F.coalesce(f"_s{i}", F.lit(0.0)) + F.lit(model.prior[i]) for i in range(k)})
    best = F.greatest(*[F.col(f"_s{i}") for i in range(k)]) if k > 1 else F.col("_s0")
    label = F.coalesce(*[F.when(F.col(f"_s{i}") == best, F.lit(c)) for i, c in enumerate(model.classes)])
    total = sum((F.exp(F.col(f"_s{i}") - best) for i in range(k)), F.lit(0.0))
    return x.withColumns({"model": F.lit(model_name), "prediction": label, "score": F.lit(1.0) / total}).drop(*[f"_s{i}" for i in range(k)])
