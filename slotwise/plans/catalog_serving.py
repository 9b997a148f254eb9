"""Registered queries: lookup table and forecast serving.

The forecast table is scored with the seasonal-naive predictor ``mean of the
demand one week earlier`` (a lookup column), so every serving query has a
DuckDB oracle; ``forecast_table_model`` scores the same slots with a fitted
OLS model, whose weights SQL solves as well (``plans/linear_sql.py``).  The error band is the validation MAE of that
naive forecast, computed from the data rather than hard-coded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.calendar import weekday_to_date
from slotwise.operators import serve as S
from slotwise.operators import splits as SP
from slotwise.operators.lookup import build_lookup, missing_keys
from slotwise.operators.metrics import regression_metrics
from slotwise.operators.moments import train_fit
from slotwise.plans import common as C
from slotwise.plans.linear_sql import fit_ctes, forecast
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import HOUR, TARGET, ZONE
from slotwise.sources import testdata

P = C.PROFILE
PREDICTOR = "mean_demand_lag_168h"
LOOKUP_DIGITS = 9  # lookup means of the reports: equal in every engine and summation order
SLOT_HOUR, SLOT_DOW = 8, 0  # Monday 8 AM: the example slot of the slot queries

LOOKUP_SQL = f"""lookup AS (SELECT {ZONE}, hour_of_day, day_of_week, round(avg(demand), 9) AS mean_demand,
  round(avg(demand_lag_1h), 9) AS mean_demand_lag_1h, round(avg(demand_lag_24h), 9) AS mean_demand_lag_24h,
  round(avg(demand_lag_168h), 9) AS mean_demand_lag_168h, round(avg(demand_rolling_3h), 9) AS mean_demand_rolling_3h,
  round(avg(demand_rolling_168h), 9) AS mean_demand_rolling_168h FROM features GROUP BY 1, 2, 3)"""
BAND_SQL = f"""band AS (SELECT avg(abs(demand_lag_168h - demand)) AS error_band FROM features
  WHERE hour >= TIMESTAMP '{P.val_start}' AND hour < TIMESTAMP '{P.test_start}')"""
FORECAST_SQL = f"""forecast AS (
  SELECT l.{ZONE} AS zone_id, coalesce(z.Zone, 'Zone ' || CAST(l.{ZONE} AS VARCHAR)) AS zone_name,
    l.hour_of_day, l.day_of_week, CAST(l.day_of_week >= 5 AS INTEGER) AS is_weekend,
    l.{PREDICTOR} AS prediction, b.error_band, l.mean_demand AS historical_mean,
    CASE WHEN l.mean_demand > 0 THEN (l.{PREDICTOR} - l.mean_demand) / l.mean_demand * 100.0 ELSE 0.0 END AS vs_avg_pct
  FROM lookup l CROSS JOIN band b LEFT JOIN zones z ON l.{ZONE} = z.LocationID)"""
BUSIEST_SQL = f"""busiest AS (SELECT arg_max({ZONE}, (s, -{ZONE})) AS zone FROM (
  SELECT {ZONE}, sum(demand) AS s FROM features GROUP BY 1))"""
BASE = C.PIPELINE_CTES.rstrip() + ",\n" + ",\n".join([testdata.ZONES_SQL, LOOKUP_SQL, BAND_SQL, FORECAST_SQL, BUSIEST_SQL]) + "\n"


def _lookup(spark, sf_dir, as_of=None):
    return build_lookup(C.features(spark, sf_dir), as_of=as_of, digits=LOOKUP_DIGITS)


def _band(features):
    val = features.filter(
        (F.col(HOUR) >= F.lit(P.val_start).cast("timestamp_ntz")) & (F.col(HOUR) < F.lit(P.test_start).cast("timestamp_ntz"))
    )
    return val.select(F.avg(F.abs(F.col("demand_lag_168h") - F.col(TARGET)))).scalar()


def _forecast(spark, sf_dir, feats=None):
    feats = feats if feats is not None else C.features_cut(spark, sf_dir)
    return S.forecast_table(build_lookup(feats, digits=LOOKUP_DIGITS), PREDICTOR, C.zones(spark, sf_dir), _band(feats))


def _busiest(feats, rank: int = 1):
    """Data-derived selection: the active zone with the largest (rank-th
    largest) total demand, ties to the smaller id."""
    totals = feats.groupBy(ZONE).agg(F.sum(TARGET).alias("s"))
    if rank == 1:
        return totals.select(F.max_by(ZONE, F.struct("s", -F.col(ZONE)))).scalar()
    # rank-th zone = the last row of a top-k (k = rank), taken as a scalar
    top = totals.orderBy(F.desc("s"), F.asc(ZONE)).limit(rank)
    return top.select(F.min_by(ZONE, F.struct("s", -F.col(ZONE)))).scalar()


_lookup_cols = "PULocationID, hour_of_day, day_of_week, " + ", ".join(
    f"round({c}, 6) AS {c}"
    for c in ["mean_demand", "mean_demand_lag_1h", "mean_demand_lag_24h", "mean_demand_lag_168h",
              "mean_demand_rolling_3h", "mean_demand_rolling_168h"]
)


@register("lookup_table", BASE + f"SELECT {_lookup_cols} FROM lookup")
def q_lookup_table(spark, sf_dir):
    """Mean demand and lag/rolling inputs per (zone, hour, weekday)."""
    return round_doubles(_lookup(spark, sf_dir))


@register(
    "zone_listing",
    BASE
    + f"""SELECT l.{ZONE} AS id, coalesce(z.Zone, 'Zone ' || CAST(l.{ZONE} AS VARCHAR)) AS name,
  coalesce(z.Borough, 'Unknown') AS borough FROM (SELECT DISTINCT {ZONE} FROM lookup) l
LEFT JOIN zones z ON l.{ZONE} = z.LocationID""",
)
def q_zone_listing(spark, sf_dir):
    """K1 + G5 + D7: zones with history and their names."""
    return S.zone_listing(_lookup(spark, sf_dir), C.zones(spark, sf_dir))


_FC_COLS = (
    "zone_id, zone_name, hour_of_day, day_of_week, is_weekend, round(prediction, 6) AS prediction, "
    "round(error_band, 6) AS error_band, round(historical_mean, 6) AS historical_mean, round(vs_avg_pct, 6) AS vs_avg_pct"
)
_LABELS = (
    "CASE WHEN hour_of_day % 12 = 0 THEN 12 ELSE hour_of_day % 12 END || CASE WHEN hour_of_day < 12 THEN ' AM' ELSE ' PM' END AS hour_label, "
    "CASE WHEN vs_avg_pct > 0 THEN '+' ELSE '' END || printf('%.1f', round(vs_avg_pct, 1)) || '%' AS vs_avg_label"
)


@register("forecast_table", BASE + f"SELECT {_FC_COLS}, {_LABELS} FROM forecast")
def q_forecast_table(spark, sf_dir):
    """K10 (+ K2 fields, B15, B17, B18): every zone x 168 slots."""
    return round_doubles(_forecast(spark, sf_dir))


# OLS from the moments of the train rows, and a request (zone, slot, weekend flag) scored by it from its lookup means.
MODEL_DIGITS = 4  # forecasts of fitted weights: equal in both engines whatever the order of their sums
_MODEL_SQL = f""", mtrain AS (SELECT * FROM features WHERE hour < TIMESTAMP '{P.val_start}'),
{fit_ctes("ols", "mtrain")},
request_features AS (SELECT r.*, CAST(r.hour_of_day IN ({C.RUSH_SQL}) AND r.day_of_week < 5 AS INTEGER) AS is_rush_hour, 0 AS is_holiday,
    mean_demand_lag_1h AS demand_lag_1h, mean_demand_lag_24h AS demand_lag_24h, mean_demand_lag_168h AS demand_lag_168h,
    mean_demand_rolling_3h AS demand_rolling_3h, mean_demand_rolling_168h AS demand_rolling_168h, mean_demand
  FROM {{requests}} r JOIN lookup USING ({ZONE}, hour_of_day, day_of_week)),
scored AS (SELECT q.*, {forecast("ols")} AS prediction FROM request_features q CROSS JOIN ols)"""


def _model_sql(requests: str) -> str:
    return _MODEL_SQL.replace("{requests}", f"({requests})")


def _train_model(feats):
    return train_fit(SP.temporal_split(feats, P.val_start, P.test_start))


_CONTRAST_SQL = _model_sql(
    f"SELECT {ZONE}, hour_of_day, day_of_week, f AS is_weekend FROM lookup, range(0, 2) t(f) WHERE {ZONE} = (SELECT zone FROM busiest) AND day_of_week = 0"
)


@register(
    "weekend_contrast",
    BASE
    + _CONTRAST_SQL
    + f"""
SELECT a.hour_of_day AS hour, a.{ZONE} AS zone_a, round(a.prediction, {MODEL_DIGITS}) AS prediction_a, b.{ZONE} AS zone_b,
  round(b.prediction, {MODEL_DIGITS}) AS prediction_b, round(a.prediction - b.prediction, {MODEL_DIGITS}) AS difference
FROM scored a JOIN scored b ON a.hour_of_day = b.hour_of_day AND a.is_weekend = 0 AND b.is_weekend = 1""",
)
def q_weekend_contrast(spark, sf_dir):
    """K8 / D9 with an independent weekend flag: Monday of the busiest zone
    scored as weekday (a) and as weekend (b) by OLS fitted on the train split."""
    feats = C.features_cut(spark, sf_dir)
    zone = _busiest_id(feats)
    out = S.compare_requests(
        spark, {"zone": zone, "dow": 0, "weekend": 0}, {"zone": zone, "dow": 0, "weekend": 1}, build_lookup(feats, digits=LOOKUP_DIGITS), _train_model(feats)
    )
    return round_doubles(out, MODEL_DIGITS)


def _busiest_id(feats) -> int:
    return feats.groupBy(ZONE).agg(F.sum(TARGET).alias("s")).agg(F.max_by(ZONE, F.struct("s", -F.col(ZONE)))).first()[0]


@register(
    "slot_requests_scored",
    BASE
    + _model_sql(f"SELECT DISTINCT {ZONE}, {SLOT_HOUR} AS hour_of_day, {SLOT_DOW} AS day_of_week, 1 AS is_weekend FROM lookup")
    + f"\nSELECT {ZONE} AS zone_id, is_weekend, round(prediction, {MODEL_DIGITS}) AS prediction FROM scored",
)
def q_slot_requests_scored(spark, sf_dir):
    """D8 + K3: every zone at one slot as requests with their own weekend flag (a Monday
    treated as a holiday), scored by the fitted model."""
    feats = C.features_cut(spark, sf_dir)
    lookup = build_lookup(feats, digits=LOOKUP_DIGITS)
    out = S.slot_predictions(lookup.select(ZONE).distinct(), SLOT_HOUR, SLOT_DOW, 1, lookup, _train_model(feats))
    return round_doubles(out, MODEL_DIGITS)


@register(
    "week_requests_scored",
    BASE
    + _model_sql(
        f"SELECT zone AS {ZONE}, CAST(i % 24 AS INTEGER) AS hour_of_day, CAST(i // 24 AS INTEGER) AS day_of_week, CAST(i // 24 >= 5 AS INTEGER) AS is_weekend FROM busiest, range(0, 168) t(i)"
    )
    + f"""
SELECT {ZONE} AS zone_id, hour_of_day, day_of_week, is_weekend, round(prediction, {MODEL_DIGITS}) AS prediction,
  round(mean_demand, {MODEL_DIGITS}) AS historical_mean FROM scored""",
)
def q_week_requests_scored(spark, sf_dir):
    """D8 + K5: the 168 requests of the busiest zone, scored by the fitted model."""
    feats = C.features_cut(spark, sf_dir)
    out = S.score_requests(S.week_requests(spark, _busiest_id(feats)), build_lookup(feats, digits=LOOKUP_DIGITS), _train_model(feats))
    return round_doubles(out.withColumnRenamed(ZONE, "zone_id"), MODEL_DIGITS)


@register(
    "forecast_table_model",
    BASE
    + _model_sql(f"SELECT {ZONE}, hour_of_day, day_of_week, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend FROM lookup")
    + f""",
mforecast AS (SELECT s.{ZONE} AS zone_id, coalesce(z.Zone, 'Zone ' || CAST(s.{ZONE} AS VARCHAR)) AS zone_name, hour_of_day, day_of_week, is_weekend,
    prediction, error_band, mean_demand AS historical_mean,
    CASE WHEN mean_demand > 0 THEN (prediction - mean_demand) / mean_demand * 100.0 ELSE 0.0 END AS vs_avg_pct
  FROM scored s CROSS JOIN band b LEFT JOIN zones z ON s.{ZONE} = z.LocationID)
SELECT {_FC_COLS.replace(", 6)", f", {MODEL_DIGITS})")}, {_LABELS} FROM mforecast""",
)
def q_forecast_table_model(spark, sf_dir):
    """K10 with a fitted model: OLS from the moments of the temporal train split
    scores every zone x 168 slot from the lookup."""
    feats = C.features_cut(spark, sf_dir)
    out = S.forecast_table(build_lookup(feats, digits=LOOKUP_DIGITS), _train_model(feats), C.zones(spark, sf_dir), _band(feats))
    return round_doubles(out, MODEL_DIGITS)


@register(
    "slot_forecast",
    BASE + f"SELECT zone_id, round(prediction, 6) AS prediction, round(historical_mean, 6) AS historical_mean "
    f"FROM forecast WHERE hour_of_day = {SLOT_HOUR} AND day_of_week = {SLOT_DOW}",
)
def q_slot_forecast(spark, sf_dir):
    """K3: all zones at one slot (Monday 8 AM)."""
    return round_doubles(S.predict_all(_forecast(spark, sf_dir), SLOT_HOUR, SLOT_DOW))


@register(
    "zone_timeline",
    BASE + "SELECT hour_of_day AS hour, round(prediction, 6) AS prediction FROM forecast "
    "WHERE zone_id = (SELECT zone FROM busiest) AND day_of_week = 0",
)
def q_zone_timeline(spark, sf_dir):
    """K4: 24-hour Monday forecast of the busiest zone."""
    feats = C.features_cut(spark, sf_dir)
    return round_doubles(S.timeline(_forecast(spark, sf_dir, feats), _busiest(feats), 0))


_heat_cols = ", ".join(f"round(max(prediction) FILTER (WHERE day_of_week = {d}), 6) AS d{d}" for d in range(7))


@register(
    "zone_heatmap",
    BASE + f"SELECT hour_of_day AS hour, {_heat_cols} FROM forecast WHERE zone_id = (SELECT zone FROM busiest) GROUP BY 1",
)
def q_zone_heatmap(spark, sf_dir):
    """K5: 24 x 7 heatmap (rows hours, columns weekdays) of the busiest zone."""
    feats = C.features_cut(spark, sf_dir)
    return round_doubles(S.heatmap_wide(S.heatmap(_forecast(spark, sf_dir, feats), _busiest(feats))))


RANK_SQL = """ranked AS (SELECT zone_id, zone_name, hour_of_day, day_of_week, is_weekend, prediction,
  CAST(row_number() OVER (PARTITION BY hour_of_day, day_of_week, is_weekend ORDER BY prediction DESC, zone_id) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY hour_of_day, day_of_week, is_weekend) AS of_zones FROM forecast)"""


@register(
    "zone_ranks",
    BASE + ", " + RANK_SQL + " SELECT zone_id, hour_of_day, day_of_week, is_weekend, round(prediction, 6) AS prediction, "
    "rank, of_zones FROM ranked",
)
def q_zone_ranks(spark, sf_dir):
    """rank of each zone at each slot, of N zones."""
    return round_doubles(S.zone_ranks(_forecast(spark, sf_dir)))


@register(
    "top_zones",
    BASE + ", " + RANK_SQL + " SELECT zone_id, zone_name, hour_of_day, day_of_week, is_weekend, "
    "round(prediction, 6) AS prediction, rank FROM ranked WHERE rank <= 5",
)
def q_top_zones(spark, sf_dir):
    """G3 + K6: the five highest forecasts of every slot, with names."""
    return round_doubles(S.top_zones(_forecast(spark, sf_dir), 5))


@register(
    "zone_intensity",
    BASE
    + """SELECT zone_id, hour_of_day, day_of_week, is_weekend, round(prediction, 6) AS prediction,
  round(CASE WHEN max(prediction) OVER (PARTITION BY hour_of_day, day_of_week, is_weekend) > 0
    THEN least(1.0, sqrt(greatest(prediction, 0.0) / max(prediction) OVER (PARTITION BY hour_of_day, day_of_week, is_weekend)))
    ELSE 0.0 END, 6) AS map_intensity,
  round(CASE WHEN max(prediction) OVER (PARTITION BY zone_id) > 0
    THEN least(1.0, greatest(prediction, 0.0) / max(prediction) OVER (PARTITION BY zone_id)) ELSE 0.0 END, 6) AS heat_intensity
FROM forecast""",
)
def q_zone_intensity(spark, sf_dir):
    """Map and heatmap shading intensities."""
    return round_doubles(S.zone_intensity(_forecast(spark, sf_dir)))


@register(
    "compare_zones",
    BASE
    + f""", second AS (SELECT {ZONE} AS zone FROM (SELECT {ZONE}, row_number() OVER (ORDER BY sum(demand) DESC, {ZONE}) AS r
  FROM features GROUP BY 1) WHERE r = 2),
a AS (SELECT hour_of_day AS hour, zone_id AS zone_a, prediction AS prediction_a FROM forecast
      WHERE zone_id = (SELECT zone FROM busiest) AND day_of_week = 0),
b AS (SELECT hour_of_day AS hour, zone_id AS zone_b, prediction AS prediction_b FROM forecast
      WHERE zone_id = (SELECT zone FROM second) AND day_of_week = 0)
SELECT coalesce(a.hour, b.hour) AS hour, zone_a, round(prediction_a, 6) AS prediction_a, zone_b,
  round(prediction_b, 6) AS prediction_b, round(prediction_a - prediction_b, 6) AS difference
FROM a FULL JOIN b ON a.hour = b.hour""",
)
def q_compare_zones(spark, sf_dir):
    """The two busiest zones' Monday timelines side by side."""
    feats = C.features_cut(spark, sf_dir)
    fc = _forecast(spark, sf_dir, feats)
    out = S.compare(fc, {"zone": _busiest(feats), "dow": 0, "weekend": 0}, {"zone": _busiest(feats, 2), "dow": 0, "weekend": 0})
    return round_doubles(out)


VAL_LOOKUP_SQL = LOOKUP_SQL.replace("lookup AS", "val_lookup AS").replace(
    "FROM features GROUP BY", f"FROM features WHERE hour < TIMESTAMP '{P.val_start}' GROUP BY"
)


@register(
    "predict_validation",
    BASE
    + ", "
    + VAL_LOOKUP_SQL
    + f"""
SELECT r.{ZONE} AS zone_id, coalesce(z.Zone, 'Zone ' || CAST(r.{ZONE} AS VARCHAR)) AS zone_name, r.hour_of_day,
  r.day_of_week, r.is_weekend, round(l.{PREDICTOR}, 6) AS prediction, round(b.error_band, 6) AS error_band,
  round(l.mean_demand, 6) AS historical_mean,
  round(CASE WHEN l.mean_demand > 0 THEN (l.{PREDICTOR} - l.mean_demand) / l.mean_demand * 100.0 ELSE 0.0 END, 6) AS vs_avg_pct
FROM (SELECT {ZONE}, hour_of_day, day_of_week, is_weekend FROM features
      WHERE hour >= TIMESTAMP '{P.val_start}' AND hour < TIMESTAMP '{P.test_start}') r
JOIN val_lookup l ON r.{ZONE} = l.{ZONE} AND r.hour_of_day = l.hour_of_day AND r.day_of_week = l.day_of_week
CROSS JOIN band b LEFT JOIN zones z ON r.{ZONE} = z.LocationID""",
)
def q_predict_validation(spark, sf_dir):
    """K2 (batch) + D4: serve every validation slot from a lookup built on
    training hours only (a backtest of the serving path)."""
    feats = C.features_cut(spark, sf_dir)
    requests = feats.filter(
        (F.col(HOUR) >= F.lit(P.val_start).cast("timestamp_ntz")) & (F.col(HOUR) < F.lit(P.test_start).cast("timestamp_ntz"))
    ).select(ZONE, "hour_of_day", "day_of_week", "is_weekend")
    out = S.predict(requests, build_lookup(feats, as_of=P.val_start, digits=LOOKUP_DIGITS), PREDICTOR, C.zones(spark, sf_dir), _band(feats))
    return round_doubles(out)


@register(
    "missing_history",
    BASE
    + f"""
SELECT DISTINCT c.{ZONE}, CAST(hour(c.hour) AS INTEGER) AS hour_of_day, CAST(isodow(c.hour) - 1 AS INTEGER) AS day_of_week
FROM cells c WHERE NOT EXISTS (SELECT 1 FROM lookup l WHERE l.{ZONE} = c.{ZONE}
  AND l.hour_of_day = hour(c.hour) AND l.day_of_week = isodow(c.hour) - 1)""",
)
def q_missing_history(spark, sf_dir):
    """Observed (zone, hour, weekday) keys without lookup history (the
    zones dropped as inactive); the strict API rejects these requests."""
    cells = C.cells(spark, sf_dir)
    req = cells.select(
        ZONE, F.hour(HOUR).alias("hour_of_day"), F.weekday(HOUR).alias("day_of_week")
    ).distinct()
    return missing_keys(req, _lookup(spark, sf_dir))


_CARD_SQL = f""", m AS (SELECT avg(abs(demand_lag_168h - demand)) AS mae, sqrt(avg((demand_lag_168h - demand) ^ 2)) AS rmse,
  1.0 - sum((demand_lag_168h - demand) ^ 2) / nullif(var_pop(demand) * count(demand), 0) AS r2,
  avg(CASE WHEN demand > 0 THEN abs((demand - demand_lag_168h) / demand) END) * 100.0 AS mape,
  avg(demand_lag_168h - demand) AS mbe FROM features
  WHERE hour >= TIMESTAMP '{P.val_start}' AND hour < TIMESTAMP '{P.test_start}'),
l AS (SELECT * FROM (SELECT round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(mape, 6) AS mape,
  round(mbe, 6) AS mbe FROM m) UNPIVOT (v FOR metric IN (mae, rmse, r2, mape, mbe)))
SELECT 'naive-lag-168h' AS version, 'Validation' AS stage,
  CASE WHEN metric = 'r2' THEN 'R²' ELSE upper(metric) END AS name,
  CASE WHEN metric = 'r2' THEN printf('%.4f', round(v, 4) + 0.0) WHEN metric = 'mape' THEN printf('%.1f%%', round(v, 1) + 0.0)
       ELSE printf('%.2f', round(v, 2) + 0.0) END AS value,
  CASE WHEN metric = 'r2' THEN printf('On a scale where forecasting the mean scores 0%% and a perfect forecast 100%%, this scores %.1f%%.', round(v * 100.0, 1) + 0.0)
       WHEN metric = 'mae' THEN printf('Predictions miss by %.2f trips per zone-hour on average.', round(v, 2) + 0.0)
       WHEN metric = 'rmse' THEN printf('Large misses weigh more: the root mean squared error is %.2f trips.', round(v, 2) + 0.0)
       WHEN metric = 'mape' THEN printf('On zone-hours with demand, the average relative miss is %.1f%%.', round(v, 1) + 0.0)
       ELSE printf('Mean bias is %.2f trips per zone-hour.', round(v, 2) + 0.0) || ' The model ' ||
            CASE WHEN v > 0 THEN 'over-predicts (overstaffing risk).' ELSE 'under-predicts (understaffing risk).' END
  END AS interpretation FROM l"""


@register("model_card", BASE + _CARD_SQL)
def q_model_card(spark, sf_dir):
    """K9 + J15: model card rows (name, value, sentence) from validation
    metrics of the seasonal-naive forecast."""
    feats = C.features(spark, sf_dir)
    val = feats.filter(
        (F.col(HOUR) >= F.lit(P.val_start).cast("timestamp_ntz")) & (F.col(HOUR) < F.lit(P.test_start).cast("timestamp_ntz"))
    ).select(TARGET, F.col("demand_lag_168h").alias("prediction"))
    metrics = regression_metrics(val, digits=6)
    return S.model_card(metrics, "naive-lag-168h", "Validation")


@register(
    "forecast_dates",
    BASE
    + """SELECT CAST(d.range AS INTEGER) AS day_of_week,
  CAST(CAST(max_hour AS DATE) + CAST(((d.range - (isodow(max_hour) - 1) - 1) % 7 + 7) % 7 + 1 AS INTEGER) AS DATE) AS forecast_date
FROM range(7) d, (SELECT max(hour) AS max_hour FROM features)""",
)
def q_forecast_dates(spark, sf_dir):
    """Calendar date of each weekday in the week after the data ends."""
    end = C.features(spark, sf_dir).select(F.max(HOUR)).scalar()
    return S.weekday_dates(spark, end)
