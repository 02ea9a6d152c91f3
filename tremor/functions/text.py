"""Text projections as Spark column expressions (normalization, input formatting, language aliases)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tremor.functions import fixed

# Python's str.isspace / re "\s" set, written so that Java regex and RE2 (DuckDB) match exactly the same
# code points: Java's and RE2's "\s" lack U+000B / U+001C..U+001F / U+0085 and the Unicode space separators.
WS_CLASS = r"[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]"
WS_RUN = WS_CLASS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC (Spark has no built-in); already-normalized strings are passed through."""
    return s.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t)
                 else unicodedata.normalize("NFKC", t))


def normalize(c) -> Column:
    """Non-string/null -> '', NFKC, drop U+FFFD, collapse whitespace runs to one space, strip.

    An ASCII text (as many bytes as characters) is its own NFKC form and does not cross into Python.
    """
    t = F.coalesce(_col(c).cast("string"), F.lit(""))
    odd = F.octet_length(t) != F.length(t)
    t = F.when(odd, nfkc(F.when(odd, t))).otherwise(t)
    t = F.replace(t, F.lit("�"), F.lit(""))
    return F.trim(F.regexp_replace(t, WS_RUN, " "))


def normalize_fields(df, task_type: str):
    """Normalize `text` for classification, `premise`/`hypothesis` for pair tasks; others unchanged."""
    if task_type == "classification":
        cols = [c for c in ("text",) if c in df.columns]
    elif task_type in ("nli", "pair"):
        cols = [c for c in ("premise", "hypothesis") if c in df.columns]
    else:
        cols = []
    return df.withColumns({c: normalize(c) for c in cols}) if cols else df


def format_input(premise="premise", hypothesis="hypothesis", text="text") -> Column:
    """Model input v1: the present fields premise, hypothesis, text joined by one space (nulls skipped)."""
    return F.concat_ws(" ", _col(premise), _col(hypothesis), _col(text))


def format_truncate(premise="premise", hypothesis="hypothesis", text="text",
                    max_chars: int | None = fixed.INPUT_TRUNCATE_CHARS) -> Column:
    """Model input v2: premise+hypothesis if both present, else text; then cut to max_chars code points."""
    p, h, t = _col(premise), _col(hypothesis), _col(text)
    joined = (F.when(p.isNotNull() & h.isNotNull(), F.concat_ws(" ", p, h))
              .when(t.isNotNull(), t)
              .otherwise(F.concat_ws(" ", p, h)))
    return joined if max_chars is None else F.substring(joined, 1, int(max_chars))


def pair_json(premise="premise", hypothesis="hypothesis") -> Column:
    """Pair input stored as compact JSON text, non-ASCII unescaped."""
    return F.to_json(F.struct(_col(premise).alias("premise"), _col(hypothesis).alias("hypothesis")))


def paraphrase_lang(lang) -> Column:
    """Synonym-lexicon language: exact key, else prefix hi/en/mr/bn, else the lower-cased value."""
    lo = F.lower(_col(lang))
    keys = list(fixed.synonym_lexicon().keys())
    expr = F.when(lo.isin(keys), lo)
    for p in fixed.PARAPHRASE_PREFIXES:
        expr = expr.when(lo.startswith(p), F.lit(p))
    return expr.otherwise(lo)


def vowel_lang(lang) -> Column:
    """Vowel-set language: exact key, else alias, else null (= unknown: text unchanged)."""
    lo = F.lower(_col(lang))
    keys = list(fixed.vowel_sets().keys())
    expr = F.when(lo.isin(keys), lo)
    for alias, code in fixed.VOWEL_ALIASES.items():
        expr = expr.when(lo == alias, F.lit(code))
    return expr


def codemix_lang(lang) -> Column:
    """Code-mix language: lower-cased only, no aliases; null when the lexicon has no entry for it."""
    lo = F.lower(_col(lang))
    return F.when(lo.isin(list(fixed.codemix_lexicon().keys())), lo)
