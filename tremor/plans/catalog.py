"""Registry of named queries (Spark) and their DuckDB oracles.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole driver tables.  Doubles are
rounded to 6 places in both engines so the value hashes agree.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tremor.shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def query(spark, sf_dir):
            ship(spark)  # executors import this package for the UDFs
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (outputs only; operators stay exact)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
