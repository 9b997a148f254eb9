"""Forecast queries as DataFrame operations.

The served model needs eleven features but a request carries four (zone,
hour of day, weekday, weekend flag).  Two are derived (rush hour, holiday=0),
one is the zone, and the five lag/rolling inputs come from the historical
lookup.  Requests are frames, so one request or every zone x 168 slots are
scored by the same plan: lookup join, then a map-only ``transform``.

A *predictor* is either a fitted ``PipelineModel`` or the name of a lookup
column used as a seasonal-naive forecast (e.g. ``mean_demand_lag_168h``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.calendar import is_rush_hour, weekday_to_date
from slotwise.functions.expressions import hour_label, pct_vs_typical, signed_pct_label
from slotwise.operators.explore import with_zone_names
from slotwise.operators.lookup import attach_lookup, missing_keys
from slotwise.schemas import FEATURE_COLS, RUSH_HOURS, TUNED_VAL_MAE, ZONE

SLOT = ["hour_of_day", "day_of_week", "is_weekend"]
REQUEST_COLS = [ZONE, *SLOT]


def validate_requests(requests: DataFrame) -> None:
    """Range check of a request batch (hour 0-23, weekday 0-6, weekend 0/1)."""
    bad = requests.agg(
        F.count_if(
            ~(
                F.col("hour_of_day").between(0, 23)
                & F.col("day_of_week").between(0, 6)
                & F.col("is_weekend").isin(0, 1)
            )
            | F.col("hour_of_day").isNull()
            | F.col("day_of_week").isNull()
            | F.col("is_weekend").isNull()
        )
    ).first()[0]
    if bad:
        raise ValueError(f"{bad} request(s) outside hour 0-23 / dow 0-6 / weekend 0-1")


def zone_listing(lookup: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones with history, ascending, with name and borough."""
    ids = lookup.select(ZONE).distinct()
    named = with_zone_names(ids, zones)
    return named.select(
        F.col(ZONE).alias("id"), F.col("zone_name").alias("name"), "borough"
    ).orderBy("id")


def slot_requests(zones: DataFrame, hour: int, dow: int, weekend: int) -> DataFrame:
    """Every zone at one slot (a projection with literals, no join)."""
    return zones.select(
        F.col(ZONE), F.lit(hour).alias("hour_of_day"), F.lit(dow).alias("day_of_week"), F.lit(weekend).alias("is_weekend")
    )


def day_requests(spark: SparkSession, zone: Column | int, dow: int, weekend: int) -> DataFrame:
    """One zone x 24 hours."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return spark.range(24).select(
        z.cast("int").alias(ZONE), F.col("id").cast("int").alias("hour_of_day"), F.lit(dow).alias("day_of_week"),
        F.lit(weekend).alias("is_weekend"),
    )


def week_requests(spark: SparkSession, zone: Column | int) -> DataFrame:
    """One zone x 24 hours x 7 days; weekend follows the weekday."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    dow = (F.col("id") / 24).cast("int")
    return spark.range(168).select(
        z.cast("int").alias(ZONE), (F.col("id") % 24).cast("int").alias("hour_of_day"), dow.alias("day_of_week"),
        (dow >= 5).cast("int").alias("is_weekend"),
    )


def lookup_slots(lookup: DataFrame) -> DataFrame:
    """K10 requests: every (zone, hour, weekday) with history, weekend from
    the weekday (the heatmap convention)."""
    return lookup.select(ZONE, "hour_of_day", "day_of_week", (F.col("day_of_week") >= 5).cast("int").alias("is_weekend"))


def request_features(with_lookup: DataFrame, rush_hours: Iterable[int] = RUSH_HOURS) -> DataFrame:
    """Eleven model inputs from a request joined with its lookup means."""
    return with_lookup.select(
        "*",
        is_rush_hour("hour_of_day", "day_of_week", rush_hours).alias("is_rush_hour"),
        F.lit(0).alias("is_holiday"),
        F.col("mean_demand_lag_1h").alias("demand_lag_1h"),
        F.col("mean_demand_lag_24h").alias("demand_lag_24h"),
        F.col("mean_demand_lag_168h").alias("demand_lag_168h"),
        F.col("mean_demand_rolling_3h").alias("demand_rolling_3h"),
        F.col("mean_demand_rolling_168h").alias("demand_rolling_168h"),
    )


def _score(feats: DataFrame, predictor) -> DataFrame:
    """J11 on request features: ``prediction`` and ``historical_mean``."""
    if isinstance(predictor, str):
        scored = feats.select("*", F.col(predictor).cast("double").alias("prediction"))
    else:
        scored = predictor.transform(feats.select(*REQUEST_COLS, *[c for c in FEATURE_COLS if c not in REQUEST_COLS], "mean_demand"))
    return scored.select(*REQUEST_COLS, "prediction", F.col("mean_demand").alias("historical_mean"))


def score_requests(requests: DataFrame, lookup: DataFrame, predictor) -> DataFrame:
    """D4 + J11: requests with history -> ``prediction`` and ``historical_mean``.

    Requests whose key has no history are skipped (batch semantics).
    """
    return _score(request_features(attach_lookup(requests.select(*REQUEST_COLS), lookup)), predictor)


def _records(scored: DataFrame, zones: DataFrame, error_band: float | Column) -> DataFrame:
    """K2 record fields: names (D7), error band (B17), percent vs typical."""
    named = with_zone_names(scored, zones)
    band = error_band if isinstance(error_band, Column) else F.lit(float(error_band))
    return named.select(
        F.col(ZONE).alias("zone_id"),
        "zone_name",
        "hour_of_day",
        "day_of_week",
        "is_weekend",
        "prediction",
        band.alias("error_band"),
        "historical_mean",
        pct_vs_typical("prediction", "historical_mean").alias("vs_avg_pct"),
    )


def predict(
    requests: DataFrame,
    lookup: DataFrame,
    predictor,
    zones: DataFrame,
    error_band: float | Column = TUNED_VAL_MAE,
    strict: bool = False,
) -> DataFrame:
    """K2: prediction records for a batch of requests.

    ``strict`` raises on a request without history (the single-request API
    answers 404); otherwise such requests are skipped.
    """
    if strict:
        validate_requests(requests)
        gone = missing_keys(requests, lookup).limit(5).collect()
        if gone:
            raise KeyError(f"no historical data for {[tuple(r) for r in gone]}")
    return _records(score_requests(requests, lookup, predictor), zones, error_band)


def forecast_table(lookup: DataFrame, predictor, zones: DataFrame, error_band: float | Column = TUNED_VAL_MAE) -> DataFrame:
    """All zones x 168 slots in one batch job, with display labels.

    The slots are the lookup's own keys, so the lookup row already carries
    every input: no request join.  K2-K8 are filters and windows over this
    table.
    """
    slots = lookup.select("*", (F.col("day_of_week") >= 5).cast("int").alias("is_weekend"))
    out = _records(_score(request_features(slots), predictor), zones, error_band)
    return out.select(
        "*",
        hour_label("hour_of_day").alias("hour_label"),
        signed_pct_label("vs_avg_pct").alias("vs_avg_label"),
    )


def predict_all(forecast: DataFrame, hour: int, dow: int) -> DataFrame:
    """K3: every zone at one slot (from the forecast table)."""
    return forecast.filter((F.col("hour_of_day") == hour) & (F.col("day_of_week") == dow)).select(
        "zone_id", "prediction", "historical_mean"
    )


def timeline(forecast: DataFrame, zone: Column | int, dow: int) -> DataFrame:
    """K4: 24 hourly predictions for one zone and weekday."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return forecast.filter((F.col("zone_id") == z) & (F.col("day_of_week") == dow)).select(
        F.col("hour_of_day").alias("hour"), "prediction"
    )


def heatmap(forecast: DataFrame, zone: Column | int) -> DataFrame:
    """K5: 168 cells (hour, dow, prediction) for one zone."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return forecast.filter(F.col("zone_id") == z).select(
        F.col("hour_of_day").alias("hour"), F.col("day_of_week").alias("dow"), "prediction"
    )


def heatmap_wide(cells: DataFrame) -> DataFrame:
    """K5 wide form: one row per hour, one column per weekday (d0..d6)."""
    wide = cells.groupBy("hour").pivot("dow", list(range(7))).agg(F.first("prediction"))
    return wide.select("hour", *[F.col(str(d)).alias(f"d{d}") for d in range(7)])


def _slot_rank(forecast: DataFrame) -> tuple:
    slot = Window.partitionBy("hour_of_day", "day_of_week", "is_weekend")
    # equal predictions are ties, broken by the zone id
    rank = F.row_number().over(slot.orderBy(F.desc("prediction"), F.asc("zone_id")))
    return rank, F.count(F.lit(1)).over(slot)


def zone_ranks(forecast: DataFrame) -> DataFrame:
    """rank of every zone within its slot (prediction desc, zone asc) of N."""
    rank, n = _slot_rank(forecast)
    return forecast.select("zone_id", *SLOT, "prediction", rank.alias("rank"), n.alias("of_zones"))


def top_zones(forecast: DataFrame, n: int = 5) -> DataFrame:
    """The n highest predictions of every slot, with names.

    One window per slot keeps the n best rows; a slot holds one row per zone,
    so each window partition is bounded by the zone count.
    """
    rank, _ = _slot_rank(forecast)
    ranked = forecast.select("zone_id", "zone_name", *SLOT, "prediction", rank.alias("rank"))
    return ranked.filter(F.col("rank") <= n)


def zone_intensity(forecast: DataFrame) -> DataFrame:
    """Map shade ``min(1, sqrt(v / max))`` across zones at a slot and
    heatmap shade ``min(1, v / max)`` across a zone's week; negative values
    and a non-positive maximum give 0."""
    slot = Window.partitionBy(*SLOT)
    week = Window.partitionBy("zone_id")
    v = F.greatest(F.col("prediction"), F.lit(0.0))
    slot_max = F.max("prediction").over(slot)
    week_max = F.max("prediction").over(week)
    return forecast.select(
        "zone_id",
        *SLOT,
        "prediction",
        F.when(slot_max > 0, F.least(F.lit(1.0), F.sqrt(v / slot_max))).otherwise(F.lit(0.0)).alias("map_intensity"),
        F.when(week_max > 0, F.least(F.lit(1.0), v / week_max)).otherwise(F.lit(0.0)).alias("heat_intensity"),
    )


def compare(forecast: DataFrame, a: dict, b: dict) -> DataFrame:
    """Two selections side by side over 24 hours.

    ``a``/``b`` hold ``zone`` (int or column) and ``dow``; rows are hours with
    both timelines and their difference.  The forecast table has the weekend
    flag of the weekday; :func:`compare_requests` takes the flag on its own.
    """
    for sel in (a, b):
        if sel.get("weekend", int(sel["dow"] >= 5)) != int(sel["dow"] >= 5):
            raise ValueError("the forecast table has no slots with another weekend flag: use compare_requests")

    def one(sel: dict, tag: str) -> DataFrame:
        z = sel["zone"] if isinstance(sel["zone"], Column) else F.lit(sel["zone"])
        rows = forecast.filter((F.col("zone_id") == z) & (F.col("day_of_week") == sel["dow"]))
        return rows.select(
            F.col("hour_of_day").alias("hour"),
            F.col("zone_id").alias(f"zone_{tag}"),
            F.col("prediction").alias(f"prediction_{tag}"),
        )

    left, right = one(a, "a"), one(b, "b")
    both = left.join(right, "hour", "full")
    return both.select(
        "hour", "zone_a", "prediction_a", "zone_b", "prediction_b",
        (F.col("prediction_a") - F.col("prediction_b")).alias("difference"),
    )


def slot_predictions(zones: DataFrame, hour: int, dow: int, weekend: int, lookup: DataFrame, predictor) -> DataFrame:
    """K3 with an independent weekend flag: every zone at one slot, scored as requests."""
    scored = score_requests(slot_requests(zones, hour, dow, weekend), lookup, predictor)
    return scored.select(F.col(ZONE).alias("zone_id"), "is_weekend", "prediction")


def day_predictions(spark: SparkSession, zone: Column | int, dow: int, weekend: int, lookup: DataFrame, predictor) -> DataFrame:
    """K4 with an independent weekend flag: 24 hourly predictions of one zone, scored as requests."""
    scored = score_requests(day_requests(spark, zone, dow, weekend), lookup, predictor)
    return scored.select(F.col("hour_of_day").alias("hour"), F.col(ZONE).alias("zone_id"), "prediction")


def compare_requests(spark: SparkSession, a: dict, b: dict, lookup: DataFrame, predictor) -> DataFrame:
    """K8 / D9 through request frames: each selection (``zone``, ``dow``, ``weekend``) is scored with its own flag."""
    def one(sel: dict, tag: str) -> DataFrame:
        rows = day_predictions(spark, sel["zone"], sel["dow"], sel["weekend"], lookup, predictor)
        return rows.select("hour", F.col("zone_id").alias(f"zone_{tag}"), F.col("prediction").alias(f"prediction_{tag}"))

    both = one(a, "a").join(one(b, "b"), "hour", "full")
    return both.select(
        "hour", "zone_a", "prediction_a", "zone_b", "prediction_b",
        (F.col("prediction_a") - F.col("prediction_b")).alias("difference"),
    )


# Sentence templates of the model card; values are filled per metric.
_CARD_TEXT = {
    "mae": "Predictions miss by %.2f trips per zone-hour on average.",
    "rmse": "Large misses weigh more: the root mean squared error is %.2f trips.",
    "r2": "On a scale where forecasting the mean scores 0%% and a perfect forecast 100%%, this scores %.1f%%.",
    "mape": "On zone-hours with demand, the average relative miss is %.1f%%.",
    "mbe": "Mean bias is %.2f trips per zone-hour.",
}


def model_card(metrics: DataFrame, version: str, stage: str) -> DataFrame:
    """K9: one row per metric: version, stage, name, value, interpretation.

    ``metrics`` is a one-row J4 frame (mae, rmse, r2, mape, mbe).
    """
    long = metrics.select("mae", "rmse", "r2", "mape", "mbe").unpivot([], ["mae", "rmse", "r2", "mape", "mbe"], "metric", "v")
    m = F.col("metric")
    v = F.col("v")
    def r(x, d):  # rounded, with -0.0 printed as 0.0
        return F.round(x, d) + F.lit(0.0)

    value = (
        F.when(m == "r2", F.format_string("%.4f", r(v, 4)))
        .when(m == "mape", F.format_string("%.1f%%", r(v, 1)))
        .otherwise(F.format_string("%.2f", r(v, 2)))
    )
    sentence = F.when(m == "r2", F.format_string(_CARD_TEXT["r2"], r(v * 100.0, 1)))
    for key in ("mae", "rmse", "mape"):
        digits = 1 if key == "mape" else 2
        sentence = sentence.when(m == key, F.format_string(_CARD_TEXT[key], r(v, digits)))
    sentence = sentence.when(
        m == "mbe",
        F.concat(F.format_string(_CARD_TEXT["mbe"], r(v, 2)), F.lit(" The model "), F.when(v > 0, F.lit("over-predicts (overstaffing risk).")).otherwise(F.lit("under-predicts (understaffing risk).")))
    )
    names = F.when(m == "r2", F.lit("R²")).otherwise(F.upper(m))
    return long.select(
        F.lit(version).alias("version"), F.lit(stage).alias("stage"), names.alias("name"), value.alias("value"),
        sentence.alias("interpretation"),
    )


def weekday_dates(spark: SparkSession, end: Column) -> DataFrame:
    """For each weekday 0..6 the first date strictly after ``end``."""
    return spark.range(7).select(
        F.col("id").cast("int").alias("day_of_week"), weekday_to_date(F.col("id").cast("int"), end).alias("forecast_date")
    )
