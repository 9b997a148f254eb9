"""Views of the driver tables in the trip data model.

The driver ships TPC-H-like tables plus an ``events`` stream; no taxi data.
``events`` plays the trip table (one event = one pickup), ``nation`` joined
with ``region`` plays the zone dimension, and ``orders`` joined with
``lineitem`` gives a pair of timestamps for duration checks.  All views are
lazy projections, so Catalyst prunes and pushes down through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.schemas import DROPOFF, PICKUP, ZONE

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trips_from_events(events: DataFrame) -> DataFrame:
    """events -> trips: ts is the pickup, user_id the pickup zone.

    ``value`` stands for both distance and fare, ``props.k`` for the
    passenger count and ``event_type`` for the payment type.
    """
    return events.select(
        F.col("event_id").alias("trip_id"),
        F.col("ts").cast("timestamp_ntz").alias(PICKUP),
        F.col("user_id").cast("int").alias(ZONE),
        F.col("value").alias("trip_distance"),
        F.col("value").alias("fare_amount"),
        # malformed values become null (and fail the range rules) instead of
        # raising under ANSI casts
        F.get_json_object("props", "$.k").try_cast("double").alias("passenger_count"),
        F.col("event_type").alias("payment_type"),
    )


def zones_from_nations(nation: DataFrame, region: DataFrame) -> DataFrame:
    """nation ⟕ region -> zone dimension ``LocationID, Zone, Borough``."""
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("int").alias("LocationID"),
        F.col("n_name").alias("Zone"),
        F.col("r_name").alias("Borough"),
    )


def trips_with_zone_names(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips with zone names attached; unmatched zones carry nulls."""
    return trips.join(zones, trips[ZONE] == zones.LocationID, "left").drop("LocationID")


def timed_trips_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """orders ⋈ lineitem -> rows with a start and an end timestamp.

    ``o_orderdate`` plays the pickup, ``l_shipdate`` the dropoff,
    ``l_quantity`` the distance and ``l_extendedprice`` the fare.
    """
    return lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").cast("timestamp_ntz").alias(PICKUP),
        F.col("l_shipdate").cast("timestamp_ntz").alias(DROPOFF),
        F.col("o_custkey").cast("int").alias(ZONE),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        F.col("o_totalprice").alias("total_amount"),
    )


# DuckDB equivalents of the views above, for the oracle queries.
TRIPS_SQL = f"""trips AS (
  SELECT event_id AS trip_id, ts AS {PICKUP}, CAST(user_id AS INTEGER) AS {ZONE},
         value AS trip_distance, value AS fare_amount,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS passenger_count,
         event_type AS payment_type
  FROM events)"""

ZONES_SQL = """zones AS (
  SELECT n.n_nationkey AS LocationID, n.n_name AS Zone, r.r_name AS Borough
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""

TIMED_TRIPS_SQL = f"""timed AS (
  SELECT o.o_orderdate AS {PICKUP}, l.l_shipdate AS {DROPOFF}, CAST(o.o_custkey AS INTEGER) AS {ZONE},
         l.l_quantity AS trip_distance, l.l_extendedprice AS fare_amount,
         CAST(l.l_linenumber AS DOUBLE) AS passenger_count, o.o_totalprice AS total_amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
