"""End-to-end feature build (the batch job behind the feature table).

trips -> clean -> hourly demand -> dense panel -> lag / rolling features ->
Parquet sink partitioned by date, then the run profile and the serving lookup
read back from the written table (the write is the lineage cut: downstream
jobs never recompute the pipeline).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.features import build_features
from slotwise.operators.lookup import build_lookup
from slotwise.operators.panel import build_panel, fill_missing_hours, hour_bounds, hourly_demand, panel_profile, zone_fills
from slotwise.operators.quality import clean_trips
from slotwise.profiles import Profile
from slotwise.schemas import FEATURE_COLS, HOUR, LAG_HOURS, PANEL_COLS, PICKUP, ROLLING_HOURS, TARGET, ZONE, assert_columns
from slotwise.sources.io import read_feature_table, write_table
from slotwise.session import configure, cut_lineage


def features_from_trips(trips: DataFrame, profile: Profile) -> DataFrame:
    """Lazy plan of the whole feature table from raw trips."""
    assert_columns(trips, [ZONE, "tpep_pickup_datetime"] + [r.col for r in profile.rules], "trips")
    panel = build_panel(
        clean_trips(trips, profile.rules),
        min_active_hours=profile.min_active_hours,
        holidays=profile.holidays,
        rush_hours=profile.rush_hours,
        with_fill=True,
    )
    feats = build_features(panel)
    assert_columns(feats, PANEL_COLS + FEATURE_COLS, "features")
    return feats


def write_features(feats: DataFrame, path: str) -> None:
    """A5: the feature table by calendar date.

    The rows are rebalanced by date before the write: small dates share a task
    (dealt by zone, every task would write a small file into every date), and a
    date above the advisory partition size is split over several.
    """
    write_table(_by_date(feats), path, partition_by=["date"], sort_within=["date", ZONE, HOUR])


def _by_date(feats: DataFrame) -> DataFrame:
    return feats.withColumn("date", F.to_date(HOUR)).hint("rebalance", F.col("date"))


def build_base(trips: DataFrame, path: str, profile: Profile, until: str, min_active_hours: int | None = None) -> None:
    """The feature table of all hours before the date ``until``, with the decisions that later dates keep.

    The active zones (C5) and their fill means (F2) are taken from these hours and
    written next to the table (``<path>_zones``); :func:`append_dates` reads them, so a
    table grown by dates equals one built at once under the same decisions.
    """
    before = trips.filter(F.col(PICKUP) < F.lit(until).cast("timestamp_ntz"))
    cells = cut_lineage(hourly_demand(clean_trips(before, profile.rules)))
    lo, _ = hour_bounds(cells)
    hi = F.lit(until).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")
    by_zone = cells.repartition(ZONE)
    least = profile.min_active_hours if min_active_hours is None else min_active_hours
    write_table(zone_fills(by_zone, lo, hi, least), f"{path}_zones")
    zones = cells.sparkSession.read.parquet(f"{path}_zones").repartition(ZONE)
    panel = fill_missing_hours(by_zone, zones, lo, hi, holidays=profile.holidays, rush_hours=profile.rush_hours)
    write_features(build_features(panel), path)


def append_dates(trips: DataFrame, path: str, profile: Profile, first: str, last: str) -> None:
    """Adds the dates ``first`` to ``last`` to a table of :func:`build_base`, without reading older history.

    Read are the trips of these dates and, by partition pruning, the demand of the
    168 hours before them (the reach of the longest lag and rolling mean); only the
    partitions of these dates are written.  A run that was lost can be repeated.
    The table must hold the date before ``first`` and none after ``last``, whose
    features would grow stale (``ValueError``).
    """
    spark = trips.sparkSession
    begin, end = F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    table = read_feature_table(spark, path)
    held = table.agg(
        F.max("date").alias("newest"), F.max(F.when(F.col("date") < F.lit(first).cast("date"), F.col("date"))).alias("before")
    ).select(
        (F.col("newest") > F.lit(last).cast("date")).alias("newer"), (F.col("before") == F.date_sub(F.lit(first).cast("date"), 1)).alias("joined")
    ).first()
    if held["newer"] or not held["joined"]:
        raise ValueError(f"{path} cannot be extended by {first} to {last}: it lacks the date before or holds later dates")
    reach = max(*LAG_HOURS, *ROLLING_HOURS)
    since = begin - F.expr(f"INTERVAL {reach} HOURS")
    halo = table.filter((F.col("date") >= F.to_date(since)) & (F.col("date") < F.to_date(begin)) & (F.col(HOUR) >= since))
    fresh = hourly_demand(clean_trips(trips.filter((F.col(PICKUP) >= begin) & (F.col(PICKUP) < end)), profile.rules))
    cells = halo.select(ZONE, HOUR, TARGET).unionByName(fresh).repartition(ZONE)
    zones = spark.read.parquet(f"{path}_zones").repartition(ZONE)
    lo = halo.select(F.min(HOUR)).scalar()
    panel = fill_missing_hours(
        cells, zones, lo, end - F.expr("INTERVAL 1 HOUR"), holidays=profile.holidays, rush_hours=profile.rush_hours
    )
    grown = _by_date(build_features(panel).filter(F.col(HOUR) >= begin)).sortWithinPartitions("date", ZONE, HOUR)
    grown.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def run(
    spark: SparkSession,
    trips: DataFrame,
    out_path: str,
    profile: Profile,
    lookup_path: str | None = None,
) -> DataFrame:
    """Build and write the feature table; returns its one-row profile.

    The table is partitioned by calendar date (so temporal splits prune
    files) and sorted by (zone, hour) inside each file.
    """
    configure(spark)
    write_features(features_from_trips(trips, profile), out_path)
    table = read_feature_table(spark, out_path)
    if lookup_path:
        write_table(build_lookup(table), lookup_path)
    return panel_profile(table.drop("date"))


def training_frame(spark: SparkSession, path: str) -> DataFrame:
    """Feature columns plus target from a written feature table."""
    return read_feature_table(spark, path).select(ZONE, HOUR, *[c for c in FEATURE_COLS if c != ZONE], TARGET)
