"""Streaming query: the scoring path over a file stream of documents (availableNow trigger)."""

from __future__ import annotations

from tremor.plans import oracle as O
from tremor.plans.catalog import register, rounded
from tremor.session import scratch_path
from tremor.sources import tables
from tremor.streaming import stream as ST

PERT, LEVEL, MODEL, THRESHOLD = "char_delete", 0.1, "stopword-t20", 0.2


def _sql() -> str:
    g = O.grid_values([(PERT, [LEVEL])])
    return O.with_(O.paired_ctes(g), f"""SELECT model, task, perturbation, level, language, id, label, pred_clean,
    round(score_clean, 6) AS score_clean, pred_pert, round(score_pert, 6) AS score_pert
  FROM paired WHERE task = 'quality' AND label <> '-1' AND model = '{MODEL}'""")


@register("stream_score", _sql)
def stream_score(spark, sf_dir):
    """Documents read as a file stream, joined to static labels, perturbed and scored; sink read back."""
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    s = ST.scored_stream(ST.document_stream(spark, sf_dir), tables.table(spark, sf_dir, "labels"),
                         PERT, LEVEL, MODEL, THRESHOLD)
    ST.run_available(s, out, ckpt)
    return rounded(spark.read.parquet(out))
