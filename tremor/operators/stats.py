"""Dataset statistics (F18): counts per split and per language within split, one grouping-sets aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_stats(examples: DataFrame) -> DataFrame:
    """(task, split) totals and (task, split, language) counts; `all_languages` = 1 marks the totals.

    A missing language column is reported as 'N/A'.
    """
    if "language" not in examples.columns:
        examples = examples.withColumn("language", F.lit("N/A"))
    return (examples.groupingSets([["task", "split"], ["task", "split", "language"]], "task", "split", "language")
            .agg(F.grouping("language").cast("tinyint").alias("all_languages"), F.count(F.lit(1)).alias("n")))
