"""Word substitution from a lexicon that is a table of any size (B11, B12), in DataFrame operations only.

The words that a text's draws choose are exploded to (key, place, trimmed word) rows and joined to the lexicon; the
replacements come back to their text as one array in the order of their places, between which its words are sliced.
No word is searched for in a list or a map of its text, so the work grows with the words alone.  The rows are written
once, as they are read three times.  A frequent token would fill one task of the join: the HOT most frequent are
broadcast and the others, none of which more than 1 / HOT of the rows hold, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import fixed, rng
from tremor.functions.text import WS_RUN
from tremor.operators.sampling import fresh
from tremor.session import written

HOT = 1000
#: The token first: its leading bytes tell rows apart in a sort.
ON = ["_t", "_l"]
#: Languages that a lexicon may have; their names are configuration.
LANGUAGES = 10_000
STRIP = {"codemix": fixed.CODEMIX_STRIP, "paraphrase": fixed.PARAPHRASE_STRIP}


def languages(lexicon: DataFrame) -> list[str]:
    rows = lexicon.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"a lexicon of more than {LANGUAGES} languages")
    return sorted(r["lang"] for r in rows if r["lang"] is not None)


def _language(lang: Column, kind: str, known: list[str]) -> Column:
    """The lexicon's language of a text, null if it has none: by name, for paraphrases else by prefix."""
    low = F.lower(lang)
    expr = F.when(low.isin(known), low)
    if kind == "paraphrase":
        for p in fixed.PARAPHRASE_PREFIXES:
            if p in known:
                expr = expr.when(low.startswith(p), F.lit(p))
    return expr


def replacements(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows of `tokens`, which has columns _l and _t, that the lexicon knows, with their replacements `_r`."""
    lex = lexicon.select(F.col("lang").alias("_l"), F.col("key").alias("_t"), F.col("replacements").alias("_r"))
    lex = lex.filter(F.size("_r") > 0).dropDuplicates(ON)
    often = tokens.groupBy(*ON).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *ON).limit(HOT)
    hot = F.broadcast(often.join(lex, ON, "left").select(*ON, "_r", F.lit(True).alias("_hot")))  # HOT rows
    x = tokens.join(hot, ON, "left")
    return (x.filter("_hot and _r is not null").drop("_hot")
            .unionByName(x.filter("_hot is null").drop("_hot", "_r").join(lex, ON)))


def substituted(df: DataFrame, lexicon: DataFrame, kind: str, level: float, key: str = "id", text: str = "text", lang: str = "language",
                out: str = "text_perturbed", seed=fixed.DEFAULT_SEED, strategy: str = "synonym") -> DataFrame:
    """`df` with `out`, the text with lexicon words replaced with probability `level`.

    `lexicon` is a table (lang, key, replacements array<string>); `kind` is 'codemix' (the first '/'-alternative of the
    first replacement) or 'paraphrase' (one replacement by a draw).  Draws are those of the Arrow kernels.  Null and
    empty texts and texts of a language that the lexicon lacks stay as they are; other texts come out with single
    spaces.  With another `strategy` than 'synonym' a paraphrase is the text itself.  `key` must be unique.
    """
    if kind not in STRIP:
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "paraphrase" and strategy != "synonym":
        return df.withColumn(out, F.col(text))
    known = languages(lexicon)
    (found,) = fresh(df, "found")
    op = f"text:{kind}"

    def split(c: str) -> Column:
        return F.array_remove(F.split(F.col(c), WS_RUN), "")

    # outer: what an inner explode (or a filter on the words) tells of its array is evaluated again, text and all
    of_lexicon = _language(F.col(lang), kind, known)
    tokens = (df.filter(F.col(key).isNotNull())
              .select(F.col(key).alias("_key"), of_lexicon.alias("_l"), rng.row_key(seed, op, key).alias("_k"), F.when(of_lexicon.isNotNull(), split(text)).alias("_words"))
              .select("_key", "_l", "_k", F.posexplode_outer("_words").alias("_i", "_w"))
              .filter(rng.draw(F.col("_k"), F.col("_i")) < rng.threshold(level))
              .select("_key", "_l", F.btrim("_w", F.lit(STRIP[kind])).alias("_t"), "_i"))
    hits = replacements(written(tokens, "tokens"), lexicon)
    pick = rng.draw(rng.row_key(seed, op + ".pick", "_key"), F.col("_i"))
    new = F.split(F.col("_r")[0], "/")[0] if kind == "codemix" else F.get("_r", (pick % F.size("_r")).cast("int"))
    hits = hits.select("_key", F.struct(F.col("_i").alias("i"), new.alias("w")).alias("_h"))
    hits = hits.repartition("_key").groupBy("_key").agg(F.sort_array(F.collect_list("_h")).alias(found))
    y = df.join(hits, df[key] == hits["_key"], "left").drop("_key")

    def merged(words: Column) -> Column:
        """The words between one replacement and the next, and the replacement; then the words behind the last."""
        def piece(hit: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(F.col(found), j - 1)["i"]).otherwise(F.lit(-1))
            gap = hit["i"] - before - 1
            gap = F.when(gap < 0, F.raise_error(F.lit("two rows with one key")).cast("int")).otherwise(gap)
            return F.concat(F.slice(words, before + 2, gap), F.array(hit["w"]))
        rest = F.slice(words, F.element_at(found, -1)["i"] + 2, F.size(words))
        return F.array_join(F.concat(F.flatten(F.transform(found, piece)), rest), " ")

    swapped = F.when(F.col(found).isNull(), F.array_join(split(text), " ")).otherwise(F.get(F.transform(F.array(split(text)), merged), F.lit(0)))
    return y.withColumn(out, F.when((F.length(text) > 0) & of_lexicon.isNotNull(), swapped).otherwise(F.col(text))).drop(found)
