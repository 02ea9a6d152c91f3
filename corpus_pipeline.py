"""A training-data pipeline: toxicity, line dedup, near-duplicate documents, benchmark decontamination, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents; the last adds the token ids and the text
they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import toxicity
from tremor.llm.common import fresh, table, written
from tremor.llm.decontaminate import without_contaminated
from tremor.llm.line_dedup import dedup_lines
from tremor.llm.piece_codec import encode_decode
from tremor.llm.simhash import one_of_each
from tremor.plans.catalog import register
from tremor.shipping import ship

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: The stages' results are no SQL (learned scores, token ids); tests/llm holds them against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]))
    score, predicted = fresh(docs, "score", "predicted")
    return toxicity.score(docs, model, out=score, predicted=predicted).filter(F.col(predicted) == 0).drop(score, predicted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line equals or nearly equals; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (3-word shingles, two bits)."""
    ship(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, rows without an id included."""
    ship(spark)
    return without_contaminated(docs, table(spark, sf_dir, "benchmark", ["item_id", "text"]), keep_unkeyed=False)


def add_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the text they decode to."""
    ship(spark)
    return encode_decode(docs, PIECE_MODEL)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", one_of_each_group),
          ("decontamination", drop_contaminated), ("sentencepiece", add_token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
