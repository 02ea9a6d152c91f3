"""Connected components of a link table, entirely on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in `links` (columns a, b); root is the smallest node it is linked to.

    Rounds of minimum labels over neighbours, hooked on to the label's own node, then a pointer jump; each
    round's labels are written to the shared folder, so no lineage grows and a lost executor costs a round at
    most.  Hot nodes: the per-node minimum is pre-aggregated, and both sides of every join are written tables
    or exchanges that adaptive execution may split.  No join is a broadcast: every round would build the labels anew
    in the driver, and their packed files hide their size.  Nulls link nothing; loops and repeated links are fine.
    """
    spark = links.sparkSession
    links = links.select("a", "b").filter("a is not null and b is not null")
    both = written(spark, links.union(links.select("b", "a")).distinct(), "links")
    labels = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
                     .withColumn("moved", F.lit(True)), "labels")
    while not labels.filter("moved").isEmpty():
        near = (both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near")))
        hooked = near.join(labels.hint("merge"), F.col("a") == F.col("node")).select(F.col("root").alias("a"), "near")
        best = near.union(hooked).groupBy("a").agg(F.min("near").alias("near"))
        step = (labels.join(best.hint("merge"), F.col("node") == F.col("a"), "left")
                .select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = written(spark, step.join(up.hint("merge"), "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("was")).alias("moved")),
                         "labels")
    return labels.select("node", "root")
