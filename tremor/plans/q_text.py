"""Text projections, perturbations and task scans (A1, A2, B1-B16) as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import fixed
from tremor.functions import text as T
from tremor.operators import lexicon as LX
from tremor.operators import perturb as P
from tremor.operators import sampling
from tremor.operators.config import dealt
from tremor.plans import oracle as O
from tremor.plans import views as V
from tremor.plans.catalog import register
from tremor.session import written
from tremor.sources import tables


def documents(spark, sf_dir):
    """Every document, normalized: id, language, text."""
    d = dealt(tables.table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string")))
    return d.select("id", F.col("lang").alias("language"), T.normalize("text").alias("text"))


def _docs_cte() -> str:
    return (f"docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, "
            f"{O.normalize_sql('text')} AS text FROM documents)")


def _one_step_sql(ptype: str, level: float, extra_cols: str = "") -> str:
    """SQL: docs perturbed by one step; columns id, language, perturbation, level, text_perturbed."""
    ctes = [_docs_cte(), *O.lexicon_ctes(),
            f"""src AS (SELECT id AS rid, id, 'text' AS side, language AS lang, {O.q(ptype)} AS ptype,
                {level!r}::DOUBLE AS level, text AS t FROM docs)""",
            *O.perturb_ctes("src", "pout")]
    body = (f"SELECT d.id, d.language, {O.q(ptype)} AS perturbation, {level!r}::DOUBLE AS level, "
            f"p.t_out AS text_perturbed{extra_cols} FROM docs d JOIN pout p ON p.rid = d.id")
    return O.with_(ctes, body)


def _one_step(spark, sf_dir, ptype: str, level: float, *extra):
    d = documents(spark, sf_dir)
    p = P.make_perturber()
    return d.select("id", "language", F.lit(ptype).alias("perturbation"), F.lit(float(level)).alias("level"),
                    P.perturb_col(p, "text", side="text", perturbation=F.lit(ptype), level=F.lit(float(level)))
                    .alias("text_perturbed"), *extra)


def _reg_step(key: str, ptype: str, level: float, doc: str):
    def q(spark, sf_dir):
        return _one_step(spark, sf_dir, ptype, level)
    q.__doc__ = doc
    register(key, lambda: _one_step_sql(ptype, level))(q)


_reg_step("noise_delete", "char_delete", 0.1, "Random character deletion at 10 % over every document (B5).")
_reg_step("noise_swap", "char_swap", 0.1, "Adjacent swaps at 10 % over every document (B6).")
_reg_step("noise_vowel", "vowel_drop", 0.3, "Language-aware vowel drop at 30 % over every document (B7).")
_reg_step("codemix", "codemix", 0.5, "Code-mixing at ratio 0.5 over every document (B11).")
_reg_step("paraphrase", "paraphrase", 0.5, "Synonym paraphrase at rate 0.5 over every document (B12).")


CHAIN = ["char_delete", "char_swap", "vowel_drop"]
CHAIN_LEVEL = 0.1


def _chain_sql() -> str:
    ctes = [_docs_cte(), *O.lexicon_ctes(),
            f"""s0 AS (SELECT id AS rid, id, 'text' AS side, language AS lang, {O.q(CHAIN[0])} AS ptype,
                {CHAIN_LEVEL!r}::DOUBLE AS level, text AS t FROM docs)"""]
    prev = "s0"
    for i, step in enumerate(CHAIN):
        ctes += O.perturb_ctes(prev, f"o{i}")
        if i + 1 < len(CHAIN):
            ctes.append(f"""s{i + 1} AS (SELECT s.rid, s.id, s.side, s.lang, {O.q(CHAIN[i + 1])} AS ptype, s.level,
                o.t_out AS t FROM {prev} s JOIN o{i} o ON o.rid = s.rid)""")
            prev = f"s{i + 1}"
    body = (f"SELECT d.id, d.language, {O.q('+'.join(CHAIN))} AS perturbation, {CHAIN_LEVEL!r}::DOUBLE AS level, "
            f"o.t_out AS text_perturbed FROM docs d JOIN o{len(CHAIN) - 1} o ON o.rid = d.id")
    return O.with_(ctes, body)


@register("noise_chain", _chain_sql)
def noise_chain(spark, sf_dir):
    """Deletion, then swap, then vowel drop at one level, each step with its own key."""
    return _one_step(spark, sf_dir, "+".join(CHAIN), CHAIN_LEVEL)


@register("normalize", lambda: O.with_([_docs_cte()], "SELECT id, language, text FROM docs"))
def normalize(spark, sf_dir):
    """NFKC, U+FFFD removal, whitespace collapse and strip over every document."""
    return documents(spark, sf_dir)


def _pairs_raw_sql(normalized: bool) -> str:
    n = O.normalize_sql if normalized else (lambda x: x)
    return f"""SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS id, 'unknown' AS language,
  'dialog' AS task, 'train' AS split, CAST(NULL AS VARCHAR) AS text, {n('u.text')} AS premise,
  {n('a.text')} AS hypothesis, CASE WHEN length(a.text) > length(u.text) THEN '1' ELSE '0' END AS label
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"""


@register("normalize_pair", lambda: _pairs_raw_sql(True))
def normalize_pair(spark, sf_dir):
    """Pair task with premise and hypothesis normalized."""
    return V.pairs(spark, sf_dir)


@register("standardize_pair", lambda: _pairs_raw_sql(False))
def standardize_pair(spark, sf_dir):
    """Raw pair rows mapped to the standard example schema (B2)."""
    return tables.scan_task(spark, sf_dir, "dialog")


def _quality_raw_sql() -> str:
    return """SELECT CAST(d.doc_id AS VARCHAR) AS id, d.lang AS language, 'quality' AS task, 'train' AS split,
  d.text AS text, CAST(NULL AS VARCHAR) AS premise, CAST(NULL AS VARCHAR) AS hypothesis,
  coalesce(CAST(l.quality AS VARCHAR), '-1') AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _benchmark_raw_sql() -> str:
    return """SELECT CAST(item_id AS VARCHAR) AS id, 'unknown' AS language, 'benchmark' AS task, 'train' AS split,
  text, CAST(NULL AS VARCHAR) AS premise, CAST(NULL AS VARCHAR) AS hypothesis, '-1' AS label FROM benchmark"""


@register("standardize_text", _quality_raw_sql)
def standardize_text(spark, sf_dir):
    """Raw documents mapped to the standard example schema (B1)."""
    return tables.scan_task(spark, sf_dir, "quality")


@register("scan_task", lambda: " UNION ALL ".join(
    [_quality_raw_sql(), _pairs_raw_sql(False), _benchmark_raw_sql()]))
def scan_task(spark, sf_dir):
    """All three tasks loaded and standardized; the unlabelled one takes the defaults (A1)."""
    return (tables.scan_task(spark, sf_dir, "quality")
            .unionByName(tables.scan_task(spark, sf_dir, "dialog"))
            .unionByName(tables.scan_task(spark, sf_dir, "benchmark")))


def _split_sql(seed=fixed.DEFAULT_SEED) -> str:
    k = O.key_sql("'split'", "id", seed)
    return f"""SELECT *, CASE WHEN u < {O.thr(str(fixed.VALIDATION_FRACTION))} THEN 'validation' ELSE 'train' END AS split2
  FROM (SELECT *, {O.draw_cols(k, '0')} FROM ({_quality_raw_sql()}))"""


@register("split_pick", lambda: f"""WITH s AS ({_split_sql()}),
  t AS (SELECT id, language, task, split2 AS split, text, premise, hypothesis, label FROM s
        UNION ALL SELECT * FROM ({_pairs_raw_sql(False)})),
  hv AS (SELECT task, max(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS hv FROM t GROUP BY task)
  SELECT t.* FROM t JOIN hv USING (task)
  WHERE t.split = CASE WHEN hv.hv = 1 THEN 'validation' ELSE 'train' END""")
def split_pick(spark, sf_dir):
    """Evaluation split per task: validation where one exists (quality after the hash split), else train (A2)."""
    q = sampling.split_hash(tables.scan_task(spark, sf_dir, "quality"))
    t = q.unionByName(tables.scan_task(spark, sf_dir, "dialog"))
    return tables.pick_split(t)


def _lang_alias_sql() -> str:
    cm_keys = ", ".join(O.q(k) for k in fixed.codemix_lexicon())
    return f"""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS language, {O.vowel_lang_sql('lang')} AS vowel_lang,
  {O.synonym_lang_sql('lang')} AS synonym_lang,
  CASE WHEN lower(lang) IN ({cm_keys}) THEN lower(lang) END AS codemix_lang FROM documents"""


@register("lang_alias", _lang_alias_sql)
def lang_alias(spark, sf_dir):
    """Language resolution of each perturbation family for every document."""
    d = tables.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"),
                    T.vowel_lang("lang").alias("vowel_lang"), T.paraphrase_lang("lang").alias("synonym_lang"),
                    T.codemix_lang("lang").alias("codemix_lang"))


@register("perturb_all", lambda: O.with_(
    [O.examples_cte(), O.pairs_cte(), O.tasks_cte(), *O.perturbed_tasks_ctes()],
    """SELECT id, task, language, perturbation, level, p_text AS text, p_premise AS premise,
       p_hypothesis AS hypothesis FROM ptasks
       UNION ALL SELECT id, task, language, 'clean', 0.0::DOUBLE, text, premise, hypothesis FROM tasks"""))
def perturb_all(spark, sf_dir):
    """Dispatcher over the whole grid for all tasks; clean rows pass through."""
    base = V.task_examples(spark, sf_dir)
    x = P.perturb(base, [("clean", 0.0), *V.grid_list()], text_cols=("text", "premise", "hypothesis"), keep_original=False)
    return x.select("id", "task", "language", "perturbation", "level", "text", "premise", "hypothesis")


@register("perturb_audit", lambda: _one_step_sql("codemix", 0.5, ", d.text AS original_text, "
                                                  "'code-mixing' AS perturbation_type"))
def perturb_audit(spark, sf_dir):
    """Provenance record: original, perturbed, language and type side by side."""
    return _one_step(spark, sf_dir, "codemix", 0.5, F.col("text").alias("original_text"),
                     F.lit("code-mixing").alias("perturbation_type"))


# ---- lexicons that are tables -------------------------------------------------------------------

TABLE_LEVEL = 0.5


def corpus_lexicon(docs, kind: str):
    """A lexicon as large as the corpus' vocabulary: half of its trimmed words (those of even length), with
    replacements made from the word."""
    strip = F.lit(fixed.CODEMIX_STRIP if kind == "codemix" else fixed.PARAPHRASE_STRIP)
    w = docs.select(F.lower("language").alias("lang"), F.explode_outer(F.array_distinct(F.transform(F.split("text", " "), lambda x: F.btrim(x, strip)))).alias("key"))
    w = w.filter((F.length("key") > 0) & (F.length("key") % 2 == 0)).distinct()
    made = [F.concat("key", F.lit("_x/"), "key")] if kind == "codemix" else [F.concat("key", F.lit(e)) for e in ("_a", "_b", "_c")]
    return w.select("lang", "key", F.array(*made).alias("replacements"))


def _table_sql(kind: str, strip: str) -> str:
    keys = f"""SELECT DISTINCT lower(language) AS l, w FROM (
    SELECT language, trim(unnest(string_split(text, ' ')), {O.q(strip)}) AS w FROM docs) WHERE w <> '' AND length(w) % 2 = 0"""
    made = (f"cmlex AS (SELECT l AS llang, w AS lkey, w || '_x/' || w AS repl FROM ({keys}))" if kind == "codemix"
            else f"synlex AS (SELECT l AS slang, w AS skey, [w || '_a', w || '_b', w || '_c'] AS syns FROM ({keys}))")
    old = "cmlex(" if kind == "codemix" else "synlex("
    ctes = [_docs_cte(), *[made if c.startswith(old) else c for c in O.lexicon_ctes()],
            f"""src AS (SELECT id AS rid, id, 'text' AS side, language AS lang, {O.q(kind)} AS ptype,
                {TABLE_LEVEL!r}::DOUBLE AS level, text AS t FROM docs)""", *O.perturb_ctes("src", "pout")]
    return O.with_(ctes, "SELECT d.id, d.language, p.t_out AS text_perturbed FROM docs d JOIN pout p ON p.rid = d.id")


def _reg_table(kind: str, strip: str, doc: str):
    def q(spark, sf_dir):
        d = written(documents(spark, sf_dir), "documents")  # read three times, the lexicon too
        return LX.substituted(d, written(corpus_lexicon(d, kind), "lexicon"), kind, TABLE_LEVEL).select("id", "language", "text_perturbed")
    q.__doc__ = doc
    register(f"{kind}_table", lambda: _table_sql(kind, strip))(q)


_reg_table("codemix", fixed.CODEMIX_STRIP, "Code-mixing from a lexicon table as large as the vocabulary, no Python (B11).")
_reg_table("paraphrase", fixed.PARAPHRASE_STRIP, "Synonym paraphrase from such a table (B12).")


@register("paraphrase_audit", lambda: _one_step_sql("paraphrase", 0.3, ", d.text AS original_text, 'synonym' AS perturbation_type"))
def paraphrase_audit(spark, sf_dir):
    """Provenance of a paraphrase: original, paraphrase, language and strategy."""
    return _one_step(spark, sf_dir, "paraphrase", 0.3, F.col("text").alias("original_text"), F.lit("synonym").alias("perturbation_type"))


def _pairs_norm_sql() -> str:
    return f"({_pairs_raw_sql(True)})"


@register("pair_json", lambda: f"""SELECT id, json_object('premise', premise, 'hypothesis', hypothesis)::VARCHAR
  AS input_json FROM {_pairs_norm_sql()}""")
def pair_json(spark, sf_dir):
    """Pair inputs stored as compact JSON with non-ASCII unescaped."""
    return V.pairs(spark, sf_dir).select("id", T.pair_json().alias("input_json"))


def _tasks_norm_sql() -> str:
    return O.with_([O.examples_cte(), O.pairs_cte(), O.tasks_cte()], "SELECT * FROM tasks")


@register("format_input", lambda: f"""SELECT id, task, concat_ws(' ', premise, hypothesis, text) AS input
  FROM ({_tasks_norm_sql()})""")
def format_input(spark, sf_dir):
    """Model input v1: present fields joined by one space, for both tasks."""
    return V.task_examples(spark, sf_dir).select("id", "task", T.format_input().alias("input"))


@register("format_truncate", lambda: f"""SELECT id, task, substring(CASE
    WHEN premise IS NOT NULL AND hypothesis IS NOT NULL THEN concat_ws(' ', premise, hypothesis)
    WHEN text IS NOT NULL THEN text ELSE concat_ws(' ', premise, hypothesis) END, 1, {fixed.INPUT_TRUNCATE_CHARS})
  AS input FROM ({_tasks_norm_sql()})""")
def format_truncate(spark, sf_dir):
    """Model input v2: pair or text, cut to 100 code points before crossing into Python."""
    return V.task_examples(spark, sf_dir).select("id", "task", T.format_truncate().alias("input"))

