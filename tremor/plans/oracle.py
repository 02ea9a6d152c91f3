"""DuckDB SQL that independently recomputes the Spark queries (the correctness oracle).

The SQL is written from the operator definitions, not generated from Spark plans: character
perturbations unnest code points and use window functions, lexicon perturbations join VALUES
tables, metrics aggregate count tables.  Fragments are composed into one WITH query per key.
"""

from __future__ import annotations

from tremor.functions import fixed, rng
from tremor.plans.views import DEFAULT_PERTURBATIONS

P = rng.P
SEED = fixed.DEFAULT_SEED
WS = r"[\s\x{0b}\p{Z}\x{1c}-\x{1f}\x{85}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def key_sql(op_sql: str, id_sql: str, seed=SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {q(str(seed))}, {op_sql}, {id_sql})), 1, 8))::BIGINT % {P})"


def draw_cols(k: str, pos: str, out: str = "u") -> str:
    """SELECT-list fragment computing the draw `out` from key column k and position pos (lateral aliases)."""
    return (f"({k} + ({pos}::BIGINT + 1) * {rng.STEP}) % {P} AS {out}_a, "
            f"({out}_a * {out}_a) % {P} AS {out}_b, ({out}_b * {out}_b) % {P} AS {out}_c, "
            f"(({out}_c * {out}_a) % {P} + {rng.SHIFT}) % {P} AS {out}_d, "
            f"({out}_d * {out}_d) % {P} AS {out}_e, ({out}_e * {out}_e) % {P} AS {out}_f, "
            f"(({out}_f * {out}_d) % {P} + {rng.SHIFT}) % {P} AS {out}")


def thr(level_sql: str) -> str:
    return f"floor({level_sql} * {float(P)})::BIGINT"


def normalize_sql(t: str) -> str:
    # NFKC is the identity on the driver tables (checked); the rest is the same expression as in Spark
    return f"trim(regexp_replace(replace(coalesce({t}, ''), '�', ''), '{WS}+', ' ', 'g'))"


# ---- base views ---------------------------------------------------------------------

def examples_cte() -> str:
    return f"""examples AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, CAST(d.lang AS VARCHAR) AS language, 'quality' AS task,
         'train' AS split, {normalize_sql('d.text')} AS text, CAST(NULL AS VARCHAR) AS premise,
         CAST(NULL AS VARCHAR) AS hypothesis, coalesce(CAST(l.quality AS VARCHAR), '-1') AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def pairs_cte() -> str:
    return f"""pairs AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS id, 'unknown' AS language,
         'dialog' AS task, 'train' AS split, CAST(NULL AS VARCHAR) AS text,
         {normalize_sql('u.text')} AS premise, {normalize_sql('a.text')} AS hypothesis,
         CASE WHEN length(a.text) > length(u.text) THEN '1' ELSE '0' END AS label
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def tasks_cte() -> str:
    return f"""tasks AS (
  SELECT * FROM examples UNION ALL SELECT * FROM pairs
  UNION ALL SELECT CAST(item_id AS VARCHAR), 'unknown', 'benchmark', 'train', {normalize_sql('text')},
                   CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '-1' FROM benchmark)"""


def grid_values(perturbations=None) -> str:
    rows = []
    for ptype, levels in (perturbations if perturbations is not None else DEFAULT_PERTURBATIONS):
        for lv in (levels or [fixed.DEFAULT_LEVEL]):
            rows.append(f"({q(ptype)}, {float(lv)!r}::DOUBLE)")
    return "grid(perturbation, level) AS (VALUES " + ", ".join(rows) + ")"


def models_values() -> str:
    return "models(model, threshold) AS (VALUES ('stopword-t20', 0.2::DOUBLE), ('stopword-t30', 0.3::DOUBLE))"


def vowels_values() -> str:
    rows = [f"({q(lang)}, {q(ch)})" for lang, chars in fixed.vowel_sets().items() for ch in chars]
    return "vowels(vlang, ch) AS (VALUES " + ", ".join(rows) + ")"


def codemix_values() -> str:
    rows = [f"({q(lang)}, {q(k)}, {q(v)})" for lang, words in fixed.codemix_lexicon().items() for k, v in words.items()]
    return "cmlex(llang, lkey, repl) AS (VALUES " + ", ".join(rows) + ")"


def synonym_values() -> str:
    rows = [f"({q(lang)}, {q(k)}, {qlist(v)})" for lang, words in fixed.synonym_lexicon().items()
            for k, v in words.items()]
    return "synlex(slang, skey, syns) AS (VALUES " + ", ".join(rows) + ")"


def vowel_lang_sql(lang: str) -> str:
    keys = ", ".join(q(k) for k in fixed.vowel_sets())
    alias = " ".join(f"WHEN lower({lang}) = {q(a)} THEN {q(c)}" for a, c in fixed.VOWEL_ALIASES.items())
    return f"CASE WHEN lower({lang}) IN ({keys}) THEN lower({lang}) {alias} END"


def synonym_lang_sql(lang: str) -> str:
    keys = ", ".join(q(k) for k in fixed.synonym_lexicon())
    pref = " ".join(f"WHEN starts_with(lower({lang}), {q(p)}) THEN {q(p)}" for p in fixed.PARAPHRASE_PREFIXES)
    return f"CASE WHEN lower({lang}) IN ({keys}) THEN lower({lang}) {pref} ELSE lower({lang}) END"


# ---- perturbation of a long (rid, id, side, lang, ptype, level, t) table ---------------------

def perturb_ctes(src: str, out: str, steps=None) -> list[str]:
    """CTEs turning `src(rid, id, side, lang, ptype, level, t)` into `out(rid, t_out)` for one-step types.

    A row's op key is side || ':' || ptype, as in the Spark kernel.  Null text is never in src.
    """
    ctes = [
        f"""{out}_ch AS (
  SELECT rid, ptype, level, vl, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS pos, len(cs) AS n, k
  FROM (SELECT rid, ptype, level, {vowel_lang_sql('lang')} AS vl, string_split(t, '') AS cs,
               {key_sql("side || ':' || ptype", 'id')} AS k
        FROM {src} WHERE ptype IN ('char_delete', 'char_swap', 'vowel_drop') AND t <> '' AND level > 0))""",
        f"""{out}_u AS (SELECT rid, ptype, level, vl, c, pos, n, {draw_cols('k', 'pos')} FROM {out}_ch)""",
        f"""{out}_del AS (
  SELECT rid, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE u >= {thr('level')}), '') AS t_out
  FROM {out}_u WHERE ptype = 'char_delete' GROUP BY rid)""",
        f"""{out}_vow AS (
  SELECT x.rid, coalesce(string_agg(x.c, '' ORDER BY x.pos)
                          FILTER (WHERE NOT (v.ch IS NOT NULL AND x.u < {thr('x.level')})), '') AS t_out
  FROM {out}_u x LEFT JOIN vowels v ON v.vlang = x.vl AND v.ch = x.c
  WHERE x.ptype = 'vowel_drop' AND x.vl IS NOT NULL GROUP BY x.rid)""",
        f"""{out}_sw AS (
  SELECT rid, c, pos, (u < {thr('level')} AND pos < n - 1) AS s FROM {out}_u WHERE ptype = 'char_swap')""",
        f"""{out}_sw2 AS (
  SELECT rid, c, pos, s, lead(c) OVER (PARTITION BY rid ORDER BY pos) AS nxt,
         coalesce(sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM {out}_sw)""",
        f"""{out}_swp AS (
  SELECT rid, string_agg(CASE WHEN s THEN nxt ELSE first_c END, '' ORDER BY pos) AS t_out
  FROM (SELECT *, first_value(c) OVER (PARTITION BY rid, seg ORDER BY pos) AS first_c FROM {out}_sw2)
  GROUP BY rid)""",
        f"""{out}_tok AS (
  SELECT rid, ptype, level, lang, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS pos, k, kp
  FROM (SELECT *, list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '') AS w,
               {key_sql("side || ':' || ptype", 'id')} AS k, {key_sql("side || ':' || ptype || '.pick'", 'id')} AS kp
        FROM {src} WHERE ptype IN ('codemix', 'paraphrase') AND t <> ''))""",
        f"""{out}_tu AS (
  SELECT rid, ptype, level, lang, w, pos, {draw_cols('k', 'pos')}, {draw_cols('kp', 'pos', 'v')}
  FROM {out}_tok)""",
        f"""{out}_cm AS (
  SELECT s.rid, coalesce(m.t_out, '') AS t_out
  FROM {src} s LEFT JOIN (
    SELECT x.rid,
           string_agg(CASE WHEN l.repl IS NOT NULL AND x.u < {thr('x.level')} THEN split_part(l.repl, '/', 1)
                           ELSE x.w END, ' ' ORDER BY x.pos) AS t_out
    FROM {out}_tu x LEFT JOIN cmlex l ON l.llang = lower(x.lang) AND l.lkey = trim(x.w, {q(fixed.CODEMIX_STRIP)})
    WHERE x.ptype = 'codemix' GROUP BY x.rid) m ON s.rid = m.rid
  WHERE s.ptype = 'codemix' AND s.t <> '' AND lower(s.lang) IN (SELECT DISTINCT llang FROM cmlex)
  UNION ALL SELECT rid, t FROM {src} WHERE ptype = 'codemix'
     AND NOT (t <> '' AND lower(lang) IN (SELECT DISTINCT llang FROM cmlex)))""",
        f"""{out}_pp AS (
  SELECT s.rid, coalesce(m.t_out, '') AS t_out
  FROM {src} s LEFT JOIN (
    SELECT x.rid,
           string_agg(CASE WHEN l.syns IS NOT NULL AND x.u < {thr('x.level')}
                           THEN l.syns[(x.v % len(l.syns)) + 1] ELSE x.w END, ' ' ORDER BY x.pos) AS t_out
    FROM {out}_tu x LEFT JOIN synlex l ON l.slang = {synonym_lang_sql('x.lang')}
                                       AND l.skey = trim(x.w, {q(fixed.PARAPHRASE_STRIP)})
    WHERE x.ptype = 'paraphrase' GROUP BY x.rid) m ON s.rid = m.rid
  WHERE s.ptype = 'paraphrase' AND s.t <> '' AND {synonym_lang_sql('s.lang')} IN (SELECT DISTINCT slang FROM synlex)
  UNION ALL SELECT rid, t FROM {src} WHERE ptype = 'paraphrase'
     AND NOT (t <> '' AND {synonym_lang_sql('lang')} IN (SELECT DISTINCT slang FROM synlex)))""",
        f"""{out} AS (
  SELECT s.rid, CASE
      WHEN s.ptype IN ('char_delete', 'char_swap', 'vowel_drop') AND (s.t = '' OR s.level <= 0) THEN s.t
      WHEN s.ptype = 'char_delete' THEN d.t_out
      WHEN s.ptype = 'char_swap' THEN coalesce(w.t_out, s.t)
      WHEN s.ptype = 'vowel_drop' THEN coalesce(v.t_out, s.t)
      WHEN s.ptype = 'codemix' THEN cm.t_out
      WHEN s.ptype = 'paraphrase' THEN pp.t_out END AS t_out
  FROM {src} s LEFT JOIN {out}_del d ON s.rid = d.rid LEFT JOIN {out}_swp w ON s.rid = w.rid
  LEFT JOIN {out}_vow v ON s.rid = v.rid LEFT JOIN {out}_cm cm ON s.rid = cm.rid
  LEFT JOIN {out}_pp pp ON s.rid = pp.rid)""",
    ]
    return ctes


def lexicon_ctes() -> list[str]:
    return [vowels_values(), codemix_values(), synonym_values()]


def stop_list() -> str:
    return qlist(fixed.RULE_STOPWORDS)


def hits_sql(t: str) -> str:
    return (f"len(list_filter(string_split(lower(coalesce({t}, '')), ' '), "
            f"lambda w: list_contains({stop_list()}, trim(w, {q(fixed.RULE_TOKEN_STRIP)}))))")


def tokens_sql(t: str) -> str:
    return f"len(string_split(coalesce({t}, ''), ' '))"


def input_sql(prefix: str = "") -> str:
    return f"concat_ws(' ', {prefix}premise, {prefix}hypothesis, {prefix}text)"


def pred_sql(h: str, n: str, th: str = "m.threshold") -> tuple[str, str]:
    share = f"(CAST({h} AS DOUBLE) / CAST({n} AS DOUBLE))"
    return (f"CASE WHEN {share} >= {th} THEN '1' ELSE '0' END",
            f"CASE WHEN {share} >= {th} THEN {share} ELSE 1.0 - {share} END")


def perturbed_tasks_ctes(grid_cte: str | None = None, tasks: str = "tasks") -> list[str]:
    """`ptasks`: tasks x grid with perturbed text/premise/hypothesis (null fields stay null)."""
    return [
        grid_cte or grid_values(),
        *lexicon_ctes(),
        f"""tg AS (SELECT t.*, g.perturbation, g.level FROM {tasks} t CROSS JOIN grid g)""",
        f"""psrc AS (
  SELECT task || '|' || id || '|' || perturbation || '|' || CAST(level AS VARCHAR) || '|' || side AS rid, id, side, language AS lang,
         perturbation AS ptype, level, t
  FROM (SELECT task, id, language, perturbation, level, 'text' AS side, text AS t FROM tg
        UNION ALL SELECT task, id, language, perturbation, level, 'premise', premise FROM tg
        UNION ALL SELECT task, id, language, perturbation, level, 'hypothesis', hypothesis FROM tg) WHERE t IS NOT NULL)""",
        *perturb_ctes("psrc", "pout"),
        f"""ptasks AS (
  SELECT tg.*, tx.t_out AS p_text, pr.t_out AS p_premise, hy.t_out AS p_hypothesis
  FROM tg
  LEFT JOIN pout tx ON tx.rid = tg.task || '|' || tg.id || '|' || tg.perturbation || '|' || CAST(tg.level AS VARCHAR) || '|text'
  LEFT JOIN pout pr ON pr.rid = tg.task || '|' || tg.id || '|' || tg.perturbation || '|' || CAST(tg.level AS VARCHAR) || '|premise'
  LEFT JOIN pout hy ON hy.rid = tg.task || '|' || tg.id || '|' || tg.perturbation || '|' || CAST(tg.level AS VARCHAR) || '|hypothesis')""",
    ]


def paired_ctes(grid_cte: str | None = None) -> list[str]:
    """`paired`: model, task, perturbation, level, language, id, label, pred/score clean and perturbed."""
    pc, sc = pred_sql("hc", "nc")
    pp, sp = pred_sql("hp", "np")
    return [
        examples_cte(), pairs_cte(), tasks_cte(), models_values(),
        *perturbed_tasks_ctes(grid_cte),
        f"""pstats AS (
  SELECT *, {hits_sql(input_sql())} AS hc, {tokens_sql(input_sql())} AS nc,
         {hits_sql(input_sql('p_'))} AS hp, {tokens_sql(input_sql('p_'))} AS np FROM ptasks)""",
        f"""paired AS (
  SELECT m.model, s.task, s.perturbation, s.level, s.language, s.id, s.label,
         {pc} AS pred_clean, {sc} AS score_clean, {pp} AS pred_pert, {sp} AS score_pert
  FROM pstats s CROSS JOIN models m)""",
    ]


def runs_ctes(grid_cte: str | None = None) -> list[str]:
    """`runs`: long prediction table (clean once at level 0.0 plus every perturbed row)."""
    pr, sr = pred_sql(hits_sql("x.inp"), tokens_sql("x.inp"))
    stored = ("CASE WHEN {p}premise IS NOT NULL AND {p}hypothesis IS NOT NULL "
              "THEN json_object('premise', {p}premise, 'hypothesis', {p}hypothesis)::VARCHAR "
              "ELSE coalesce({p}text, '') END")
    return [
        examples_cte(), pairs_cte(), tasks_cte(), models_values(),
        *perturbed_tasks_ctes(grid_cte),
        f"""long_in AS (
  SELECT task, 'clean' AS perturbation, 0.0::DOUBLE AS level, language, id, label, {input_sql()} AS inp,
         {stored.format(p='')} AS stored FROM tasks
  UNION ALL
  SELECT task, perturbation, level, language, id, label, {input_sql('p_')},
         {stored.format(p='p_')} FROM ptasks)""",
        f"""runs AS (
  SELECT m.model, x.task, x.perturbation, x.level, x.language, x.id, x.stored AS text, x.label,
         {pr} AS prediction, {sr} AS score
  FROM long_in x CROSS JOIN models m)""",
    ]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- metric fragments ------------------------------------------------------------------

def f1_cte(name: str, cnt: str, keys: list[str], label: str, pred: str, out: str) -> str:
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, avg(CASE WHEN sup + prd > 0 THEN 2.0 * tp / (sup + prd) ELSE 0.0 END) AS {out}
  FROM (SELECT {k}, cls, sum(tp) AS tp, sum(sup) AS sup, sum(prd) AS prd FROM (
          SELECT {k}, {label} AS cls, CASE WHEN {label} IS NOT DISTINCT FROM {pred} THEN n ELSE 0 END AS tp,
                 n AS sup, 0 AS prd FROM {cnt}
          UNION ALL SELECT {k}, {pred} AS cls, 0, 0, n FROM {cnt}) GROUP BY {k}, cls)
  GROUP BY {k})"""


def rel(c: str, p: str) -> str:
    return f"CASE WHEN {c} > 0 THEN ({c} - {p}) / {c} ELSE 0.0 END"


def r6(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"


def paired_report_ctes(keys: list[str]) -> list[str]:
    k = ", ".join(keys)
    return [
        f"""pcnt AS (SELECT {k}, label, pred_clean, pred_pert, count(*) AS n FROM paired
  GROUP BY {k}, label, pred_clean, pred_pert)""",
        f1_cte("f1c", "pcnt", keys, "label", "pred_clean", "f1_clean"),
        f1_cte("f1p", "pcnt", keys, "label", "pred_pert", "f1_perturbed"),
        f"""pbase AS (
  SELECT {k},
    sum(CASE WHEN label IS NOT DISTINCT FROM pred_clean THEN n ELSE 0 END) / sum(n) AS acc_clean,
    sum(CASE WHEN label IS NOT DISTINCT FROM pred_pert THEN n ELSE 0 END) / sum(n) AS acc_perturbed,
    sum(CASE WHEN pred_clean IS NOT DISTINCT FROM pred_pert THEN n ELSE 0 END) / sum(n) AS consistency,
    sum(n) AS n
  FROM pcnt GROUP BY {k})""",
        f"""report AS (
  SELECT b.*, f1c.f1_clean, f1p.f1_perturbed,
    b.acc_clean - b.acc_perturbed AS abs_drop_acc, {rel('b.acc_clean', 'b.acc_perturbed')} AS rel_drop_acc,
    f1c.f1_clean - f1p.f1_perturbed AS abs_drop_f1, {rel('f1c.f1_clean', 'f1p.f1_perturbed')} AS rel_drop_f1
  FROM pbase b JOIN f1c USING ({k}) JOIN f1p USING ({k}))""",
    ]


SUMMARY = ["acc_clean", "acc_perturbed", "abs_drop_acc", "rel_drop_acc",
           "f1_clean", "f1_perturbed", "abs_drop_f1", "rel_drop_f1", "consistency"]


def report_select(keys: list[str], where: str = "") -> str:
    cols = ", ".join([*keys, *[r6(c, c) for c in SUMMARY], "CAST(n AS BIGINT) AS n"])
    return f"SELECT {cols} FROM report {where}"
