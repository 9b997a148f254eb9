"""Serving tables in storage: the lookup and the forecast, bucketed by zone.

A bucketed table is dealt and sorted by zone once, when it is written.  The answer for
one zone then reads one bucket (a literal zone id prunes the others), and a batch of
requests meets the table without a shuffle of the table: only the requests are dealt by
zone, or broadcast by Spark where they are small.

The files lie at a path of the caller's, and the columns, the key and the number of buckets in a
one-row table next to them (``<path>_buckets``), so that another session, whose catalog
has not seen the table, opens it with :func:`open_bucketed`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.sources.io import write_table

#: Buckets of a serving table: one file each; 265 zones leave about four zones a bucket.
SERVING_BUCKETS = 64


def _fresh_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = SERVING_BUCKETS, name: str = "serving") -> DataFrame:
    """Write ``df`` at ``path`` in ``buckets`` files by ``key`` and return it as a table."""
    spark = df.sparkSession
    table = _fresh_name(name)
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    write_table(spark.createDataFrame([(columns, key, buckets)], "columns string, key string, buckets int").coalesce(1), f"{path}_buckets")
    return spark.table(table)


def open_bucketed(spark: SparkSession, path: str, name: str = "serving") -> DataFrame:
    """A table of :func:`write_bucketed`, registered anew in this session's catalog."""
    spec = spark.read.parquet(f"{path}_buckets").first()
    table = _fresh_name(name)
    spark.sql(
        f"CREATE TABLE {table} ({spec['columns']}) USING parquet CLUSTERED BY (`{spec['key']}`) SORTED BY (`{spec['key']}`) "
        f"INTO {spec['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def deal_requests(requests: DataFrame, key: str, buckets: int = SERVING_BUCKETS) -> DataFrame:
    """A large batch of requests dealt like the table it will be joined to."""
    return requests.repartition(buckets, F.col(key))
