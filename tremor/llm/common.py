"""Helpers shared by the operators: table reads, column clashes, written intermediates, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tremor.session import shared_dir

#: Characters of text handled at once inside a task (a longer single text is a slice of its own).
SLICE_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """One table of the data folder, pruned to `columns`."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with no column of `df` (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns an operator is about to add: an input column of that name is replaced."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def with_fields(df: DataFrame, *fields: StructField) -> StructType:
    return StructType([*df.schema.fields, *fields])


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into row ranges of about `limit` characters; nulls of `column` come as ''."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= limit:
                yield batch.slice(at, i + 1 - at), [t or "" for t in texts[at:i + 1]]
                at, size = i + 1, 0
        if at < len(texts):
            yield batch.slice(at), [t or "" for t in texts[at:]]


def appended(batch: pa.RecordBatch, arrays: Sequence[pa.Array], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
