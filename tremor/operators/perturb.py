"""Perturbation operators (character noise, code-mixing, paraphrase) as DataFrame transforms.

One perturbation of one column is an Arrow `pandas_udf`; a whole grid over several columns crosses into
Python once per example (`one_pass`).  The lexicons and vowel sets are
parameters of the driver program, of any size it holds; they travel in the UDF closure (a broadcast).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tremor.functions import fixed
from tremor.functions.kernels import Perturber, join_fields, stopword_stats


def make_perturber(seed=fixed.DEFAULT_SEED, vowels=None, codemix=None, synonyms=None,
                   strict: bool = True) -> Perturber:
    return Perturber(
        seed,
        vowels if vowels is not None else fixed.vowel_sets(),
        codemix if codemix is not None else fixed.codemix_lexicon(),
        synonyms if synonyms is not None else fixed.synonym_lexicon(),
        strict,
    )


def perturb_udf(perturber: Perturber, side: str = "text"):
    """Arrow UDF (id, text, language, perturbation, level) -> perturbed text."""

    @F.pandas_udf(StringType())
    def _perturb(ids: pd.Series, texts: pd.Series, langs: pd.Series, perts: pd.Series,
                 levels: pd.Series) -> pd.Series:
        out = [perturber.apply(t, i, lg, p, float(lv), side)
               for i, t, lg, p, lv in zip(ids, texts, langs, perts, levels)]
        return pd.Series(out, dtype=object)

    return _perturb


FIELDS = ("text", "premise", "hypothesis")
STATS_TYPE = StructType([StructField("n_tokens", LongType()), StructField("n_hits", LongType())])


def stats_udf(words=None):
    """Arrow UDF (premise, hypothesis, text) -> (n_tokens, n_hits) of the rule model on the joined input."""
    ws = frozenset(words or fixed.RULE_STOPWORDS)

    @F.pandas_udf(STATS_TYPE)
    def _stats(premise: pd.Series, hypothesis: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = [stopword_stats(join_fields(p, h, t), ws) for p, h, t in zip(premise, hypothesis, text)]
        return pd.DataFrame(out, columns=["n_tokens", "n_hits"], dtype="int64")

    return _stats


def perturb_col(perturber: Perturber, text="text", side: str = "text", id_col="id", lang="language",
                perturbation="perturbation", level="level") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return perturb_udf(perturber, side)(c(id_col).cast("string"), c(text), c(lang), c(perturbation),
                                        c(level).cast("double"))


def perturb(df: DataFrame, grid, text_cols=("text",), perturber: Perturber | None = None,
            keep_original: bool = True) -> DataFrame:
    """Every example under every (perturbation, level) of `grid`, a small table or pairs.

    A text crosses into Python once for the whole grid (`one_pass.crossed`) and is exploded in the JVM.  A clean row
    is given only if the grid names one.  Pair tasks perturb both sides with independent keys; nulls stay null.
    """
    from tremor.operators import one_pass as OP

    if isinstance(grid, DataFrame):
        grid = [tuple(r) for r in grid.select("perturbation", F.col("level").cast("double")).collect()]
    rows = OP.grid_rows(grid)
    others = [c for c in df.columns if c not in text_cols]
    kept = [f"_kept{i}" for i in range(len(others))]
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(others, kept, strict=True)], "id", "language",
                       *[F.col(c) if c in text_cols else F.lit(None).cast("string").alias(c) for c in FIELDS])
    x = OP.crossed(source, rows, (), perturber, with_text=True, normalize=False, keep=kept)
    first = 0 if any(p == "clean" for p, _ in grid) else 1
    x = x.select(*kept, "texts", F.posexplode("texts").alias("_g", "_t")).filter(F.col("_g") >= first)
    names = [OP.CLEAN, *rows]
    return x.select(*[F.col(k).alias(c) for c, k in zip(others, kept, strict=True)], *[F.col("_t")[c].alias(c) for c in text_cols],
                    F.get(F.array(*[F.lit(p) for p, _ in names]), F.col("_g")).alias("perturbation"),
                    F.get(F.array(*[F.lit(float(lv)) for _, lv in names]), F.col("_g")).alias("level"),
                    *([F.get("texts", F.lit(0))[c].alias(f"original_{c}") for c in text_cols] if keep_original else []))
