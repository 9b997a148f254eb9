"""Registered queries: the feature-build pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.cube import cells_of
from slotwise.operators.panel import dropped_zones, panel_profile, zone_filter_report
from slotwise.operators.quality import clean_report, period_report
from slotwise.plans import common as C
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import PICKUP, ZONE

P = C.PROFILE


@register(
    "hourly_demand",
    C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS) + "SELECT * FROM cells",
)
def q_hourly_demand(spark, sf_dir):
    """C1 -> B2 -> E0: trips per (zone, hour), observed cells only."""
    return C.cells(spark, sf_dir)


_rule_checks = "\n  UNION ALL ".join(
    f"SELECT '{r.label}' AS rule, count(*) AS rows_before, "
    f"count(*) FILTER (WHERE NOT coalesce({C._rule_sql(r)}, false)) AS rows_removed FROM trips"
    for r in P.rules
)


@register(
    "clean_report",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT rule, rows_before, rows_removed, rows_before - rows_removed AS rows_after,
       round(rows_removed * 100.0 / rows_before, 6) AS pct_removed
FROM ({_rule_checks}
  UNION ALL SELECT 'all rules', count(*), count(*) FILTER (WHERE NOT coalesce({C.CLEAN_WHERE}, false)) FROM trips) t""",
)
def q_clean_report(spark, sf_dir):
    """Rows removed per cleaning rule and overall."""
    return round_doubles(clean_report(C.trips(spark, sf_dir), P.rules))


@register(
    "period_report",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT count(*) AS rows,
  count(*) FILTER (WHERE NOT ({PICKUP} >= TIMESTAMP '2024-01-01' AND {PICKUP} < TIMESTAMP '2024-01-29')) AS rows_outside,
  min({PICKUP}) FILTER (WHERE NOT ({PICKUP} >= TIMESTAMP '2024-01-01' AND {PICKUP} < TIMESTAMP '2024-01-29')) AS first_outside,
  max({PICKUP}) FILTER (WHERE NOT ({PICKUP} >= TIMESTAMP '2024-01-01' AND {PICKUP} < TIMESTAMP '2024-01-29')) AS last_outside
FROM trips""",
)
def q_period_report(spark, sf_dir):
    """Rows outside a half-open study period (here the training weeks)."""
    return period_report(C.trips(spark, sf_dir), "2024-01-01", P.test_start)


@register("demand_panel", C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS, C.CTE_PANEL) + "SELECT * FROM panel")
def q_demand_panel(spark, sf_dir):
    """D2 + D3 + C5 (R1 order): dense zone x hour panel with calendar columns."""
    return C.panel(spark, sf_dir)


@register(
    "dropped_zones",
    C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS)
    + f"""SELECT {ZONE}, count(*) FILTER (WHERE demand > 0) AS active_hours FROM cells
GROUP BY 1 HAVING count(*) FILTER (WHERE demand > 0) < {C.MIN_ACTIVE}""",
)
def q_dropped_zones(spark, sf_dir):
    """Zones below the activity threshold."""
    return dropped_zones(C.cells(spark, sf_dir), P.min_active_hours)


@register(
    "feature_table",
    C.PIPELINE_CTES
    + f"""SELECT {ZONE}, hour, demand, hour_of_day, day_of_week, is_weekend, is_rush_hour, is_holiday,
  round(demand_lag_1h, 6) AS demand_lag_1h, round(demand_lag_24h, 6) AS demand_lag_24h,
  round(demand_lag_168h, 6) AS demand_lag_168h, round(demand_rolling_3h, 6) AS demand_rolling_3h,
  round(demand_rolling_168h, 6) AS demand_rolling_168h FROM features""",
)
def q_feature_table(spark, sf_dir):
    """F1 -> F2 -> F3: the full 14-column feature table."""
    return round_doubles(C.features(spark, sf_dir))


@register(
    "feature_profile",
    C.PIPELINE_CTES
    + f"""SELECT count(*) AS rows, count(DISTINCT {ZONE}) AS zones, min(hour) AS min_hour, max(hour) AS max_hour,
  count(*) FILTER (WHERE demand = 0) AS zero_rows, round(avg(CAST(demand = 0 AS DOUBLE)) * 100.0, 6) AS zero_pct,
  count(*) FILTER (WHERE demand IS NULL) AS nulls_demand,
  count(*) FILTER (WHERE hour_of_day IS NULL) AS nulls_hour_of_day,
  count(*) FILTER (WHERE day_of_week IS NULL) AS nulls_day_of_week,
  count(*) FILTER (WHERE is_weekend IS NULL) AS nulls_is_weekend,
  count(*) FILTER (WHERE is_rush_hour IS NULL) AS nulls_is_rush_hour,
  count(*) FILTER (WHERE is_holiday IS NULL) AS nulls_is_holiday,
  count(*) FILTER (WHERE demand_lag_1h IS NULL) AS nulls_demand_lag_1h,
  count(*) FILTER (WHERE demand_lag_24h IS NULL) AS nulls_demand_lag_24h,
  count(*) FILTER (WHERE demand_lag_168h IS NULL) AS nulls_demand_lag_168h,
  count(*) FILTER (WHERE demand_rolling_3h IS NULL) AS nulls_demand_rolling_3h,
  count(*) FILTER (WHERE demand_rolling_168h IS NULL) AS nulls_demand_rolling_168h
FROM features""",
)
def q_feature_profile(spark, sf_dir):
    """Run profile of the feature table (rows, zones, range, zeros, nulls)."""
    return round_doubles(panel_profile(C.features(spark, sf_dir)))


@register(
    "zone_filter_report",
    C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS)
    + f""", hrs AS (SELECT CAST(date_diff('hour', min(hour), max(hour)) + 1 AS BIGINT) AS h FROM cells),
act AS (SELECT {ZONE}, count(*) FILTER (WHERE demand > 0) AS a FROM cells GROUP BY 1),
agg AS (SELECT count(*) AS zones_before, count(*) FILTER (WHERE a >= {C.MIN_ACTIVE}) AS zones_after,
  sum(a) FILTER (WHERE a >= {C.MIN_ACTIVE}) AS nonzero_after FROM act)
SELECT zones_before, zones_after, zones_before - zones_after AS zones_dropped, zones_before * h AS rows_before,
  zones_after * h AS rows_after, CAST(zones_after * h - coalesce(nonzero_after, 0) AS BIGINT) AS zero_rows_kept,
  round((zones_after * h - coalesce(nonzero_after, 0)) * 100.0 / nullif(zones_after * h, 0), 6) AS zero_pct
FROM agg, hrs""",
)
def q_zone_filter_report(spark, sf_dir):
    """C5 report: zones and panel rows before/after the activity filter, zero share kept."""
    return round_doubles(zone_filter_report(cells_of(C.cube(spark, sf_dir), "clean"), P.min_active_hours))
