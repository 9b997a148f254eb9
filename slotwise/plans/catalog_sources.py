"""Registered queries for the sources and sinks (A1-A7): round trips through the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators import models as M
from slotwise.operators import splits as SP
from slotwise.operators.lookup import build_lookup
from slotwise.operators.panel import hourly_demand
from slotwise.plans import common as C
from slotwise.operators import serve as S
from slotwise.plans.catalog_serving import BASE, LOOKUP_DIGITS, MODEL_DIGITS, PREDICTOR, _band, _busiest_id, _model_sql, _train_model
from slotwise.plans.feature_build import append_dates, build_base, write_features
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import HOUR, PICKUP, TARGET, TRIP_SCHEMA, ZONE
from slotwise.session import ensure_checkpoint_dir
from slotwise.sources import testdata
from slotwise.sources.io import load_model, read_feature_table, read_trips, read_zone_csv, read_zone_geojson, save_model, write_table
from slotwise.sources.serving_store import open_bucketed, write_bucketed

P = C.PROFILE


def _path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "trip_scan",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT {ZONE}, count(*) AS trips, count(passenger_count) AS with_passengers,
  round(sum(trip_distance), 4) AS distance, min({PICKUP}) AS first_pickup FROM trips GROUP BY 1""",
)
def q_trip_scan(spark, sf_dir):
    """A1: trips written as Parquet with other numeric types (longs for integers), scanned back in the contract's."""
    trips = C.trips(spark, sf_dir)
    wide = []
    for f in TRIP_SCHEMA.fields:
        kind = T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType
        known = f.name in trips.columns and f.name != "payment_type"
        wide.append((F.col(f.name) if known else F.lit(None)).cast(kind).alias(f.name))
    path = _path(spark, "trips")
    trips.select(*wide).write.parquet(path)
    return read_trips(spark, path).groupBy(ZONE).agg(
        F.count(F.lit(1)).alias("trips"), F.count("passenger_count").alias("with_passengers"),
        F.round(F.sum("trip_distance"), 4).alias("distance"), F.min(PICKUP).alias("first_pickup"),
    )


@register("zone_csv", "WITH " + testdata.ZONES_SQL + " SELECT LocationID, Zone, Borough FROM zones")
def q_zone_csv(spark, sf_dir):
    """A3: the zone dimension written as CSV and read back."""
    path = _path(spark, "zones-csv")
    C.zones(spark, sf_dir).write.option("header", True).csv(path)
    return read_zone_csv(spark, path)


@register("zone_geojson", "WITH " + testdata.ZONES_SQL + " SELECT LocationID, Zone, Borough FROM zones")
def q_zone_geojson(spark, sf_dir):
    """A4: the zone dimension written as one GeoJSON document (25 features) and read back."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("LocationID").alias("location_id"), F.col("Zone").alias("zone"), F.col("Borough").alias("borough")).alias("properties"))
    # location id 0 counts as absent in the reader, so ids are shifted by one on the way
    zones = C.zones(spark, sf_dir).withColumn("LocationID", F.col("LocationID") + 1)
    document = zones.agg(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))
    path = _path(spark, "zones-geojson")
    document.coalesce(1).write.json(path)
    return read_zone_geojson(spark, path).withColumn("LocationID", F.col("LocationID") - 1)


@register(
    "feature_sink_slice",
    C.PIPELINE_CTES
    + f"""SELECT {ZONE}, hour, demand, round(demand_lag_168h, 6) AS demand_lag_168h FROM features
WHERE hour >= TIMESTAMP '{P.val_start}' AND hour < TIMESTAMP '{P.test_start}'""",
)
def q_feature_sink_slice(spark, sf_dir):
    """A5 + A2 + C6: the feature table written by date; the validation week read back from its partitions only."""
    path = _path(spark, "features")
    write_features(C.features(spark, sf_dir), path)
    week = SP.time_slice(read_feature_table(spark, path), P.val_start, P.test_start)
    return round_doubles(week.select(ZONE, HOUR, TARGET, "demand_lag_168h"))


#: Activity threshold of the three weeks before the first appended date.
GROWN_ACTIVE = 24
_GROWN_CTES = C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS) + f""", bounds AS (
  SELECT min(hour) AS lo, date_trunc('day', max(hour)) + INTERVAL 23 HOUR AS hi FROM cells),
chosen AS (SELECT {ZONE} FROM cells WHERE hour < TIMESTAMP '{P.val_start}' GROUP BY 1 HAVING count(*) >= {GROWN_ACTIVE}),
panel AS (SELECT g.{ZONE}, g.hour, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand, {C.calendar_sql('g.hour')}
  FROM (SELECT z.{ZONE}, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS hour FROM chosen z CROSS JOIN bounds b) g
  LEFT JOIN cells c ON g.{ZONE} = c.{ZONE} AND g.hour = c.hour),
""" + C.CTE_FEATURES.replace(
    f"avg(demand) OVER (PARTITION BY {ZONE}, hour_of_day)",
    f"avg(CASE WHEN hour < TIMESTAMP '{P.val_start}' THEN demand END) OVER (PARTITION BY {ZONE}, hour_of_day)",
)


@register(
    "features_appended",
    _GROWN_CTES
    + f"""SELECT {ZONE}, hour, demand, hour_of_day, day_of_week, is_weekend, is_rush_hour, is_holiday,
  round(demand_lag_1h, 6) AS demand_lag_1h, round(demand_lag_24h, 6) AS demand_lag_24h,
  round(demand_lag_168h, 6) AS demand_lag_168h, round(demand_rolling_3h, 6) AS demand_rolling_3h,
  round(demand_rolling_168h, 6) AS demand_rolling_168h FROM features""",
)
def q_features_appended(spark, sf_dir):
    """F1-F3 + A5, incremental: three weeks built at once, a week and then single dates appended; the SQL builds all at once."""
    trips, path = C.trips(spark, sf_dir), _path(spark, "grown")
    build_base(trips, path, P, P.val_start, GROWN_ACTIVE)
    newest = C.clean(spark, sf_dir).agg(F.to_date(F.max(PICKUP)).alias("d")).first()["d"]
    day = dt.date.fromisoformat(P.test_start)
    append_dates(trips, path, P, P.val_start, str(day - dt.timedelta(days=1)))
    while day <= newest:
        append_dates(trips, path, P, str(day), str(day))
        day += dt.timedelta(days=1)
    return round_doubles(read_feature_table(spark, path).drop("date"))


@register("lookup_sink", BASE + f"SELECT {ZONE}, hour_of_day, day_of_week, round(mean_demand, 6) AS mean_demand FROM lookup")
def q_lookup_sink(spark, sf_dir):
    """The lookup table written and read back."""
    path = _path(spark, "lookup")
    write_table(build_lookup(C.features(spark, sf_dir), digits=LOOKUP_DIGITS), path)
    return round_doubles(spark.read.parquet(path).select(ZONE, "hour_of_day", "day_of_week", "mean_demand"))


@register(
    "model_round_trip",
    C.PIPELINE_CTES
    + f"""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM features
WHERE hour >= TIMESTAMP '{P.val_start}' AND hour < TIMESTAMP '{P.test_start}'""",
)
def q_model_round_trip(spark, sf_dir):
    """OLS saved and loaded; validation forecasts that changed (none)."""
    feats = SP.temporal_split(C.features_cut(spark, sf_dir), P.val_start, P.test_start)
    model = M.fit(M.linear_regression(), feats.filter(F.col("split") == "train"))
    path = _path(spark, "model")
    save_model(model, path)
    val = feats.filter(F.col("split") == "val")
    before = M.predict(model, val, keep=[ZONE, HOUR]).select(ZONE, HOUR, F.col("prediction").alias("a"))
    after = M.predict(load_model(path), val, keep=[ZONE, HOUR]).select(ZONE, HOUR, F.col("prediction").alias("b"))
    return before.join(after, [ZONE, HOUR]).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@register(
    "hourly_demand_null_keys",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT {ZONE}, date_trunc('hour', {PICKUP}) AS hour, count(*) AS demand FROM trips
WHERE trip_id % 7 <> 0 AND trip_id % 11 <> 0 GROUP BY 1, 2""",
)
def q_hourly_demand_null_keys(spark, sf_dir):
    """E0 on trips whose zone (every 7th) or time (every 11th) is missing: such rows are in no cell."""
    trips = C.trips(spark, sf_dir)
    return hourly_demand(trips.withColumns({
        ZONE: F.when(F.col("trip_id") % 7 != 0, F.col(ZONE)), PICKUP: F.when(F.col("trip_id") % 11 != 0, F.col(PICKUP)),
    }))


@register(
    "stored_forecast_week",
    BASE + "SELECT hour_of_day AS hour, day_of_week AS dow, round(prediction, 6) AS prediction FROM forecast WHERE zone_id = (SELECT zone FROM busiest)",
)
def q_stored_forecast_week(spark, sf_dir):
    """K5 from storage: the forecast written in buckets by zone, opened again, one zone's week read from its bucket."""
    feats = C.features_cut(spark, sf_dir)
    path = _path(spark, "forecast")
    write_bucketed(S.forecast_table(build_lookup(feats, digits=LOOKUP_DIGITS), PREDICTOR, C.zones(spark, sf_dir), _band(feats)), path, "zone_id")
    return round_doubles(S.heatmap(open_bucketed(spark, path), _busiest_id(feats)))


@register(
    "stored_lookup_requests",
    BASE
    + _model_sql(f"SELECT {ZONE}, hour_of_day, day_of_week, CAST(day_of_week < 5 AS INTEGER) AS is_weekend FROM lookup WHERE hour_of_day >= 18")
    + f"\nSELECT {ZONE}, hour_of_day, day_of_week, is_weekend, round(prediction, {MODEL_DIGITS}) AS prediction, round(mean_demand, {MODEL_DIGITS}) AS historical_mean FROM scored",
)
def q_stored_lookup_requests(spark, sf_dir):
    """K2 in batch from storage: evening requests of every zone with a weekend flag of their own (here the
    weekday's opposite), met with the lookup in its buckets and scored by the fitted model."""
    feats = C.features_cut(spark, sf_dir)
    path = _path(spark, "lookup")
    write_bucketed(build_lookup(feats, digits=LOOKUP_DIGITS), path, ZONE)
    lookup = open_bucketed(spark, path)
    requests = S.lookup_slots(lookup).filter(F.col("hour_of_day") >= 18).withColumn("is_weekend", 1 - F.col("is_weekend"))
    out = S.score_requests(requests, lookup, _train_model(feats))
    return round_doubles(out, MODEL_DIGITS)
