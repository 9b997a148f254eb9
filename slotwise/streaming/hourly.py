"""Incremental hourly demand (E0 as a Structured Streaming job).

New trip files are read as a stream, cleaned with the same range rules,
counted per (zone, 1-hour event-time window) and appended to a Parquet table
once the watermark closes a window (late trips up to ``lateness`` still
count).  State is bounded by the open windows of the watermark horizon.
The dense panel, lags and rolling means need a closed calendar, so they run
as batch jobs over the table this stream maintains.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.quality import clean_trips
from slotwise.profiles import EVENTS, Profile
from slotwise.schemas import HOUR, PICKUP, TARGET, ZONE
from slotwise.session import ensure_checkpoint_dir
from slotwise.sources.testdata import trips_from_events

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def hourly_demand_stream(
    events: DataFrame, profile: Profile = EVENTS, lateness: str = "1 hour"
) -> DataFrame:
    """Streaming E0: ``PULocationID, hour, demand`` per closed hour window.

    ``withWatermark`` needs a ``TIMESTAMP`` column, so the wall-clock pickup is
    read as UTC for event-time tracking and cast back to NTZ on output.
    """
    trips = clean_trips(trips_from_events(events), profile.rules)
    timed = trips.withColumn("__et", F.col(PICKUP).cast("timestamp")).withWatermark("__et", lateness)
    counts = timed.groupBy(F.col(ZONE), F.window("__et", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias(TARGET))
    return counts.select(ZONE, F.col("w.start").cast("timestamp_ntz").alias(HOUR), TARGET)


def run_hourly_demand(
    spark: SparkSession,
    source_dir: str,
    sink_path: str,
    checkpoint_path: str,
    file_glob: str = "events*.parquet",
    profile: Profile = EVENTS,
    lateness: str = "1 hour",
    max_files_per_trigger: int | None = None,
):
    """Process every file present now (``availableNow``) and stop.

    Rerunning with the same checkpoint picks up only files added since.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = hourly_demand_stream(reader.parquet(source_dir), profile, lateness)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start(sink_path)
    )
    query.awaitTermination()
    return query


def shared_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Sink and checkpoint folders under the session's shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tag = f"{name}-{uuid.uuid4().hex[:12]}"
    return f"{base}/tables/{tag}", f"{base}/streams/{tag}"


def closed_hours_sql(lateness_hours: int = 1) -> str:
    """Batch definition of what the stream has emitted once all data is read:
    windows ending at or before (latest event time - lateness)."""
    return f"hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {lateness_hours} HOUR"
