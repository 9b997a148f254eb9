"""Named queries over the driver tables, each with an optional DuckDB oracle.

A query is a function ``(spark, sf_dir) -> DataFrame``.  Its oracle is an SQL
string over the raw tables (``events``, ``nation`` ...) that DuckDB runs on
the same Parquet files; column names are aliased identically on both sides
and floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL, if SQL-expressible)."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (oracle comparisons hash values)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def load_all() -> None:
    """Import every catalog module so their queries register."""
    from slotwise.plans import (  # noqa: F401
        catalog_explore,
        catalog_models,
        catalog_pipeline,
        catalog_quality,
        catalog_serving,
        catalog_sources,
        catalog_splits,
        catalog_streaming,
    )
