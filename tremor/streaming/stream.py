"""The row-wise operators on a stream: labelled documents arriving as files are normalized, perturbed and scored.

The original has no streaming code; every perturbation and the rule model are stateless projections, and the
label lookup is a stream-static join, so the same functions run under Structured Streaming unchanged.
`trigger(availableNow=True)` processes what is present and stops; the checkpoint makes a restart resume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.text import normalize
from tremor.operators import perturb as P
from tremor.operators import score as S

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, pattern: str = "documents.parquet",
                    max_bytes: str | None = None) -> DataFrame:
    """Documents arriving as files, or as folders of files, named by `pattern`; `max_bytes` (such as '10g') bounds a
    micro-batch, by default Spark decides.

    The name is part of the path, as a pattern: a filter on file names would miss the files of a folder of that name,
    and a plain path could not be one file.
    """
    reader = spark.readStream.schema(DOC_SCHEMA)
    glob = f"[{pattern[0]}]{pattern[1:]}" if pattern[0].isalnum() else pattern
    return (reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader).parquet(f"{folder.rstrip('/')}/{glob}")


def scored_stream(docs: DataFrame, labels: DataFrame, perturbation: str, level: float,
                  model: str, threshold: float) -> DataFrame:
    """Stream x static labels -> normalized text -> one perturbation -> clean and perturbed prediction."""
    x = (docs.join(labels.select("doc_id", "quality"), "doc_id")
         .select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("language"),
                 F.col("quality").cast("string").alias("label"), normalize("text").alias("text")))
    p = P.make_perturber()
    x = x.withColumn("text_pert", P.perturb_col(p, "text", side="text", perturbation=F.lit(perturbation),
                                                level=F.lit(float(level))))
    sc, sp = S.rule_stats("text"), S.rule_stats("text_pert")
    pc, scc = S.rule_predict(sc["n_hits"], sc["n_tokens"], threshold)
    pp, spp = S.rule_predict(sp["n_hits"], sp["n_tokens"], threshold)
    return x.select(F.lit(model).alias("model"), F.lit("quality").alias("task"),
                    F.lit(perturbation).alias("perturbation"), F.lit(float(level)).alias("level"),
                    "language", "id", "label", pc.alias("pred_clean"), scc.alias("score_clean"),
                    pp.alias("pred_pert"), spp.alias("score_pert"))


def run_available(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process all that is present, however long it takes."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).outputMode("append").start(out_path))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
