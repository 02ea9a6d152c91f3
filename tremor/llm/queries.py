"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import periodic_runs, pii, quality, toxicity, url_filter
from tremor.llm.common import table, written
from tremor.llm.decontaminate import contaminated
from tremor.llm.fill_in_middle import fill_in_middle, restored
from tremor.llm.hilbert_search import nearest
from tremor.llm.line_dedup import dedup_lines
from tremor.llm.piece_codec import digests, encode_decode
from tremor.llm.simhash import fingerprints, near_duplicates
from tremor.llm.token_counts import count_tokens
from tremor.llm.token_files import read_token_files, token_digests, write_token_files
from tremor.plans.catalog import register
from tremor.session import scratch_path

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    return digests(encode_decode(table(spark, sf_dir, "documents", ["doc_id", "text"]), PIECE_MODEL))


@register("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at two or fewer differing bits."""
    prints = written(spark, fingerprints(table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("text"), "prints")
    return near_duplicates(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to ORC in document order, then read back: start, length and checksum."""
    path = scratch_path(spark, "llm-tokens")
    write_token_files(table(spark, sf_dir, "documents", ["doc_id", "text"]), path, BYTE_TOKENIZER, end_id=2)
    return token_digests(read_token_files(spark, path))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole document; labels outside the held-out fold train the two models."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    return toxicity.score(docs, model).select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


_LINE_SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
worded as (select doc_id, pos, line, list_filter(string_split(line, ' '), lambda x: x <> '') as words from lines),
uniq as (select words, min(doc_id * 1048576 + pos) as spot from worded where len(words) > 0 group by words),
places as (select spot, words, unnest(range(1, len(words) + 1)) as i from uniq where len(words) >= 5),
variants as (select spot, i, list_concat(words[1:i - 1], words[i + 1:]) as rest from places),
near as (
  select a.spot from variants a join (select i, rest, min(spot) as spot from variants group by i, rest) b on a.i = b.i and a.rest = b.rest where a.spot > b.spot
  union select v.spot from variants v join uniq u on v.rest = u.words where v.spot > u.spot
  union select u.spot from variants v join uniq u on v.rest = u.words where u.spot > v.spot),
marked as (
  select doc_id, pos, line, len(words) = 0 as blank,
         doc_id * 1048576 + pos in (select spot from uniq) and doc_id * 1048576 + pos not in (select spot from near) as kept
  from worded),
cleaned as (
  select doc_id, count(*) as n_lines, count(*) filter (kept) as n_kept, coalesce(string_agg(line, chr(10) order by pos) filter (kept or blank), '') as text
  from marked group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_kept, 0) as bigint) as n_kept, c.text
from documents d left join cleaned c using (doc_id)
"""


@register("op9_line_dedup", lambda: _LINE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals or nearly equals."""
    return dedup_lines(table(spark, sf_dir, "documents", ["doc_id", "text"]), lines="n_lines", kept="n_kept").select("doc_id", "n_lines", "n_kept", "text")


@register("op3_hilbert_search")
def op3_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return nearest(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), F.col("vec_id") % 50 == 0)


@register("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within a fifth of its words in edits."""
    return contaminated(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: the patterns' spans and the field's."""
    field = pii.train(pii.labelled_table(spark))
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents", ["doc_id", "text"]), field))


@register("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    return url_filter.judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"])).select("page_id", "host", "path", "rule", "verdict")


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents", ["doc_id", "text"]), PIECE_MODEL).select("doc_id", "n_tokens")


@register("op11_fill_in_middle")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut at line ends and rearranged, and the text rebuilt from that, as digests."""
    out = fill_in_middle(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every periodic run of words of every whole document, one in ten with a planted one, as digests."""
    docs = periodic_runs.planted(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    out = periodic_runs.find_runs(docs).drop("text").withColumn("best", periodic_runs.greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op13_quality")
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document; labels outside the held-out fold train the model."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    known = written(spark, quality.statistics(docs).drop("text"), "statistics")
    model = quality.fit(known, table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return quality.score(known, model).select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
