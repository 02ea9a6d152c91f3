"""Configuration: rows (grids, models, label maps) as small tables, and the caller's session settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many configuration rows a table is marked for broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 10_000


def config_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table of driver-side configuration rows; its size is known here, so the broadcast mark is checked."""
    rows = list(rows)
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


#: Session setting: partitions to deal a task's rows to (round-robin) before the CPU-heavy stages.  Unset, the
#: input splits decide; a caller sets it for a small input stored as one large row group.
INPUT_PARTITIONS = "tremor.input.partitions"


def dealt(df: DataFrame) -> DataFrame:
    """`df`, dealt to the caller's number of partitions where the session names one."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, "")
    return df.repartition(int(n)) if n else df
