"""Shared building blocks of the registered queries (driver-table inputs).

Each helper returns a lazy plan; nothing is cached across queries, so every
registered query reads its tables and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.cube import trip_cube
from slotwise.operators.features import build_features
from slotwise.operators.panel import build_panel, hourly_demand
from slotwise.operators.quality import clean_trips, rules_predicate
from slotwise.profiles import EVENTS, Profile
from slotwise.schemas import PICKUP, ZONE
from slotwise.session import cut_lineage
from slotwise.sources import testdata

PROFILE: Profile = EVENTS


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.trips_from_events(testdata.load(spark, sf_dir, "events"))


def clean(spark: SparkSession, sf_dir: str, profile: Profile = PROFILE) -> DataFrame:
    return clean_trips(trips(spark, sf_dir), profile.rules)


def cells(spark: SparkSession, sf_dir: str, profile: Profile = PROFILE) -> DataFrame:
    return hourly_demand(clean(spark, sf_dir, profile), ZONE, PICKUP)


def cube(spark: SparkSession, sf_dir: str, profile: Profile = PROFILE) -> DataFrame:
    """The trip cube of the reports, written once: one scan of the trips for any number of them."""
    zone, distance, fare = F.col(ZONE), F.col("trip_distance"), F.col("fare_amount")
    conditions = {
        "clean": rules_predicate(profile.rules),
        "bad_distance": distance <= 0,
        "negative_fare": fare < 0,
        "bad_zone": zone.isNull() | (zone <= 0),
    }
    return cut_lineage(trip_cube(trips(spark, sf_dir), conditions))


def panel(spark: SparkSession, sf_dir: str, profile: Profile = PROFILE, with_fill: bool = False) -> DataFrame:
    return build_panel(
        clean(spark, sf_dir, profile),
        min_active_hours=profile.min_active_hours,
        holidays=profile.holidays,
        rush_hours=profile.rush_hours,
        with_fill=with_fill,
    )


def features(spark: SparkSession, sf_dir: str, profile: Profile = PROFILE) -> DataFrame:
    return build_features(panel(spark, sf_dir, profile, with_fill=True))


def features_cut(
    spark: SparkSession, sf_dir: str, profile: Profile = PROFILE, columns: list[str] | None = None
) -> DataFrame:
    """The feature table checkpointed once, for queries that read it more than
    once (positions need a counting pass, serving needs lookup and error band):
    later passes re-read the checkpoint instead of re-running the windows.

    ``columns`` keeps only what the query needs: a checkpoint is row based,
    so pruning happens before it (and Catalyst then drops unused windows).
    """
    df = features(spark, sf_dir, profile)
    return cut_lineage(df.select(*columns) if columns else df)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.zones_from_nations(
        testdata.load(spark, sf_dir, "nation"), testdata.load(spark, sf_dir, "region")
    )


# ---------------------------------------------------------------------------
# SQL fragments for the DuckDB oracles (same profile values as above).
# ---------------------------------------------------------------------------
def _rule_sql(rule) -> str:
    lo = ">" if rule.lo_open else ">="
    return f"{rule.col} {lo} {rule.lo!r} AND {rule.col} <= {rule.hi!r}"


CLEAN_WHERE = " AND ".join(_rule_sql(r) for r in PROFILE.rules)
HOLIDAYS_SQL = ", ".join(f"DATE '{d}'" for d in PROFILE.holidays)
RUSH_SQL = ", ".join(str(h) for h in PROFILE.rush_hours)
MIN_ACTIVE = PROFILE.min_active_hours


def calendar_sql(ts: str) -> str:
    """hour_of_day, day_of_week (Mon=0), is_weekend, is_rush_hour, is_holiday."""
    dow = f"(isodow({ts}) - 1)"
    return (
        f"CAST(hour({ts}) AS INTEGER) AS hour_of_day, CAST({dow} AS INTEGER) AS day_of_week, "
        f"CAST({dow} >= 5 AS INTEGER) AS is_weekend, "
        f"CAST(hour({ts}) IN ({RUSH_SQL}) AND {dow} < 5 AS INTEGER) AS is_rush_hour, "
        f"CAST(CAST({ts} AS DATE) IN ({HOLIDAYS_SQL}) AS INTEGER) AS is_holiday"
    )


CTE_TRIPS = testdata.TRIPS_SQL
CTE_CLEAN = f"clean AS (SELECT * FROM trips WHERE {CLEAN_WHERE})"
CTE_CELLS = (
    f"cells AS (SELECT {ZONE}, date_trunc('hour', {PICKUP}) AS hour, count(*) AS demand "
    f"FROM clean GROUP BY 1, 2)"
)
# Reference order: densify every zone over the global range, then drop the
# inactive zones (the Spark side filters first; results must agree).
CTE_PANEL = f"""bounds AS (SELECT min(hour) AS lo, max(hour) AS hi FROM cells),
all_zones AS (SELECT DISTINCT {ZONE} FROM cells),
grid AS (SELECT z.{ZONE}, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS hour
         FROM all_zones z CROSS JOIN bounds b),
dense AS (SELECT g.{ZONE}, g.hour, CAST(coalesce(c.demand, 0) AS BIGINT) AS demand
          FROM grid g LEFT JOIN cells c ON g.{ZONE} = c.{ZONE} AND g.hour = c.hour),
active AS (SELECT {ZONE} FROM dense GROUP BY 1 HAVING count(*) FILTER (WHERE demand > 0) >= {MIN_ACTIVE}),
panel AS (SELECT d.{ZONE}, d.hour, d.demand, {calendar_sql('d.hour')}
          FROM dense d WHERE d.{ZONE} IN (SELECT {ZONE} FROM active))"""
CTE_FEATURES = f"""lagged AS (
  SELECT *,
    CAST(lag(demand, 1) OVER w AS DOUBLE) AS l1, CAST(lag(demand, 24) OVER w AS DOUBLE) AS l24,
    CAST(lag(demand, 168) OVER w AS DOUBLE) AS l168,
    avg(demand) OVER (PARTITION BY {ZONE}, hour_of_day) AS fill,
    coalesce(avg(demand) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0) AS r3,
    coalesce(avg(demand) OVER (w ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0.0) AS r168
  FROM panel WINDOW w AS (PARTITION BY {ZONE} ORDER BY hour)),
features AS (
  SELECT {ZONE}, hour, demand, hour_of_day, day_of_week, is_weekend, is_rush_hour, is_holiday,
    coalesce(l1, fill) AS demand_lag_1h, coalesce(l24, fill) AS demand_lag_24h,
    coalesce(l168, fill) AS demand_lag_168h, r3 AS demand_rolling_3h, r168 AS demand_rolling_168h
  FROM lagged)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


PIPELINE_CTES = with_ctes(CTE_TRIPS, CTE_CLEAN, CTE_CELLS, CTE_PANEL, CTE_FEATURES)
