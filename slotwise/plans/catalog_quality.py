"""Registered queries: data-quality audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import duration_minutes
from slotwise.operators.quality import (
    describe,
    drop_sparse_by_decision,
    duplicate_rows,
    joint_missingness,
    key_validity,
    null_audit,
    quality_audit,
    time_sanity,
    value_counts,
    value_sanity,
)
from slotwise.plans import common as C
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import DROP_NULL_PCT, DROPOFF, PICKUP, ZONE
from slotwise.session import ensure_checkpoint_dir
from slotwise.sources import testdata

NAMED_TRIP_COLS = [
    "trip_id", PICKUP, ZONE, "trip_distance", "fare_amount", "passenger_count", "payment_type", "Zone", "Borough",
]
CTE_NAMED = f"""named AS (SELECT t.*, z.Zone, z.Borough FROM trips t LEFT JOIN zones z ON t.{ZONE} = z.LocationID)"""
NAMED_CTES = C.with_ctes(C.CTE_TRIPS, testdata.ZONES_SQL, CTE_NAMED)
TIMED_CTES = C.with_ctes(
    testdata.TIMED_TRIPS_SQL,
    testdata.ZONES_SQL,
    f"named AS (SELECT t.*, z.Zone, z.Borough FROM timed t LEFT JOIN zones z ON t.{ZONE} = z.LocationID)",
)


def named_trips(spark, sf_dir):
    return testdata.trips_with_zone_names(C.trips(spark, sf_dir), C.zones(spark, sf_dir))


def named_timed_trips(spark, sf_dir):
    timed = testdata.timed_trips_from_orders(
        testdata.load(spark, sf_dir, "orders"), testdata.load(spark, sf_dir, "lineitem")
    )
    return testdata.trips_with_zone_names(timed, C.zones(spark, sf_dir))


_null_rows = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS null_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS null_pct FROM named"
    for c in NAMED_TRIP_COLS
)


@register("null_audit", NAMED_CTES + f"SELECT * FROM ({_null_rows}) t")
def q_null_audit(spark, sf_dir):
    """Null count and % per column of the trips with zone names."""
    return null_audit(named_trips(spark, sf_dir))


@register(
    "sparse_columns",
    NAMED_CTES + f"SELECT \"column\", null_pct FROM ({_null_rows}) t WHERE null_pct > {DROP_NULL_PCT}",
)
def q_sparse_columns(spark, sf_dir):
    """C4: the columns a missingness threshold of 30% would drop."""
    return null_audit(named_trips(spark, sf_dir)).filter(F.col("null_pct") > DROP_NULL_PCT).select(
        "column", "null_pct"
    )


_LATER = "TIMESTAMP '2024-01-15'"


@register(
    "sparse_columns_dropped",
    NAMED_CTES + f"SELECT trip_id, {PICKUP}, {ZONE}, trip_distance, fare_amount, passenger_count, payment_type FROM named WHERE {PICKUP} >= {_LATER}",
)
def q_sparse_columns_dropped(spark, sf_dir):
    """C4: the first half month decides which columns are too sparse; the second half loses the same ones."""
    named = named_trips(spark, sf_dir)
    decision = f"{ensure_checkpoint_dir(spark)}/sparse-{uuid.uuid4().hex}"
    drop_sparse_by_decision(named.filter(F.expr(f"{PICKUP} < {_LATER}")), decision)
    return drop_sparse_by_decision(named.filter(F.expr(f"{PICKUP} >= {_LATER}")), decision)


_JOINT = ["Zone", "Borough", "passenger_count"]
_jn = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _JOINT)


@register(
    "joint_missingness",
    NAMED_CTES
    + f"""SELECT count(*) FILTER (WHERE {_jn} = {len(_JOINT)}) AS all_missing,
  count(*) FILTER (WHERE {_jn} > 0) AS any_missing,
  count(*) FILTER (WHERE {_jn} > 0 AND {_jn} < {len(_JOINT)}) AS partly_missing FROM named""",
)
def q_joint_missingness(spark, sf_dir):
    """Rows with all / any / some of the zone-name and passenger columns missing."""
    return joint_missingness(named_trips(spark, sf_dir), _JOINT)


_DUP_COLS = [PICKUP, ZONE, "trip_distance", "passenger_count", "payment_type"]


@register(
    "duplicate_rows",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS c FROM trips GROUP BY {', '.join(_DUP_COLS)}) g""",
)
def q_duplicate_rows(spark, sf_dir):
    """Repeated trips (all columns but the id)."""
    return duplicate_rows(C.trips(spark, sf_dir), _DUP_COLS)


@register(
    "order_line_duplicates",
    """SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) g""",
)
def q_order_line_duplicates(spark, sf_dir):
    """E3 on a wide table with real repeats (lineitem without its keys)."""
    li = testdata.load(spark, sf_dir, "lineitem")
    return duplicate_rows(li, ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"])


@register(
    "time_sanity",
    C.with_ctes(testdata.TIMED_TRIPS_SQL)
    + f"""SELECT count(*) FILTER (WHERE {PICKUP} > {DROPOFF}) AS pickup_after_dropoff,
  count(*) FILTER (WHERE epoch_us({DROPOFF}) - epoch_us({PICKUP}) <= 0) AS nonpositive_duration FROM timed""",
)
def q_time_sanity(spark, sf_dir):
    """E4 on order date -> ship date pairs."""
    timed = testdata.timed_trips_from_orders(
        testdata.load(spark, sf_dir, "orders"), testdata.load(spark, sf_dir, "lineitem")
    )
    return time_sanity(timed)


@register(
    "value_sanity",
    C.with_ctes(C.CTE_TRIPS)
    + """SELECT check, rows FROM (
  SELECT 1 AS o, 'nonpositive_distance' AS check, count(*) FILTER (WHERE trip_distance <= 0) AS rows FROM trips
  UNION ALL SELECT 2, 'passengers_above_6', count(*) FILTER (WHERE passenger_count > 6) FROM trips
  UNION ALL SELECT 3, 'passengers_below_0', count(*) FILTER (WHERE passenger_count < 0) FROM trips
  UNION ALL SELECT 4, 'negative_fare_amount', count(*) FILTER (WHERE fare_amount < 0) FROM trips
  UNION ALL SELECT 5, 'zero_fare_amount', count(*) FILTER (WHERE fare_amount = 0) FROM trips) t""".replace(
        "check", '"check"'
    ),
)
def q_value_sanity(spark, sf_dir):
    """E5: impossible distances, passenger counts and fares."""
    return value_sanity(C.trips(spark, sf_dir))


@register(
    "key_validity",
    C.with_ctes(C.CTE_TRIPS)
    + f"""SELECT count(*) FILTER (WHERE {ZONE} <= 0) AS invalid_key, count(*) FILTER (WHERE {ZONE} IS NULL) AS missing_key,
  count(*) FILTER (WHERE {ZONE} IS NULL OR {ZONE} <= 0) AS invalid_or_missing_key FROM trips""",
)
def q_key_validity(spark, sf_dir):
    """Pickup-zone key validity."""
    return key_validity(C.trips(spark, sf_dir))


def _audit_sql() -> str:
    parts = []
    for c in ("Zone", "Borough"):
        parts.append((f"Missing values in {c}", f"{c} IS NULL"))
    parts += [
        ("Pickup after dropoff", f"{PICKUP} > {DROPOFF}"),
        ("Zero/negative trip duration", f"epoch_us({DROPOFF}) - epoch_us({PICKUP}) <= 0"),
        ("Zero/negative trip distance", "trip_distance <= 0"),
        ("Negative fare_amount", "fare_amount < 0"),
        ("Negative total_amount", "total_amount < 0"),
        (f"Invalid or missing {ZONE}", f"{ZONE} IS NULL OR {ZONE} <= 0"),
    ]
    rows = "\n  UNION ALL ".join(
        f"SELECT '{issue}' AS issue, count(*) FILTER (WHERE {cond}) AS count, count(*) AS n FROM named"
        for issue, cond in parts
    )
    return TIMED_CTES + f"""SELECT issue, count, printf('%.2f%%', round(count * 100.0 / n, 2)) AS percent_of_rows
FROM ({rows}) t"""


@register("quality_audit", _audit_sql())
def q_quality_audit(spark, sf_dir):
    """The audit table (issue, count, percent) over order/ship-date trips.

    The explanatory text columns are constant per issue and left out of the
    oracle comparison by projecting them away here.
    """
    audit = quality_audit(named_timed_trips(spark, sf_dir), missing_cols=["Zone", "Borough"])
    return audit.select("issue", "count", "percent_of_rows")


def _audit_report_sql() -> str:
    from slotwise.operators.quality import _AUDIT_TEXT

    kinds = {
        "Missing values in Zone": "missing",
        "Missing values in Borough": "missing",
        "Pickup after dropoff": "pickup_after_dropoff",
        "Zero/negative trip duration": "nonpositive_duration",
        "Zero/negative trip distance": "nonpositive_distance",
        "Negative fare_amount": "negative_fare_amount",
        "Negative total_amount": "negative_total_amount",
        f"Invalid or missing {ZONE}": "invalid_or_missing_key",
    }

    def case(i):
        return "CASE issue " + " ".join(f"WHEN '{k}' THEN '{_AUDIT_TEXT[v][i]}'" for k, v in kinds.items()) + " END"

    return f"SELECT *, {case(0)} AS why_it_matters, {case(1)} AS likely_handling FROM ({_audit_sql()}) a"


@register("quality_audit_report", _audit_report_sql())
def q_quality_audit_report(spark, sf_dir):
    """E7 with the why / handling explanation columns."""
    return quality_audit(named_timed_trips(spark, sf_dir), missing_cols=["Zone", "Borough"])


_PCTS = (0.01, 0.5, 0.99)
_MOMENTS = ("mean", "std")  # their last bits depend on the order of summation


def _stable(described: DataFrame) -> DataFrame:
    """Described statistics with mean and std rounded; counts and order statistics stay exact."""
    return described.withColumn("value", F.when(F.col("statistic").isin(*_MOMENTS), F.round("value", 6)).otherwise(F.col("value")))


def _describe_sql(col: str, source: str) -> str:
    stats = [
        ("count", f"CAST(count({col}) AS DOUBLE)"),
        ("mean", f"avg({col})"),
        ("std", f"stddev_samp({col})"),
        ("min", f"min({col})"),
    ]
    stats += [(f"p{p * 100:g}", f"quantile_cont({col}, {p})") for p in _PCTS]
    stats += [("max", f"max({col})")]
    return "\n  UNION ALL ".join(
        f"SELECT '{col}' AS column, '{s}' AS statistic, {f'round({e}, 6)' if s in _MOMENTS else f'CAST({e} AS DOUBLE)'} AS value FROM {source}"
        for s, e in stats
    )


@register(
    "describe_trips",
    C.with_ctes(C.CTE_TRIPS)
    + _describe_sql("trip_distance", "trips")
    + "\n  UNION ALL "
    + _describe_sql("passenger_count", "trips"),
)
def q_describe_trips(spark, sf_dir):
    """Count, mean, std, min, p1, p50, p99, max of distance and passengers."""
    return _stable(describe(C.trips(spark, sf_dir), ["trip_distance", "passenger_count"], _PCTS))


@register(
    "describe_duration",
    C.with_ctes(
        testdata.TIMED_TRIPS_SQL,
        f"d AS (SELECT (epoch_us({DROPOFF}) - epoch_us({PICKUP})) / 60000000.0 AS duration_min FROM timed)",
    )
    + _describe_sql("duration_min", "d"),
)
def q_describe_duration(spark, sf_dir):
    """B9 + E8: trip duration in minutes (order date -> ship date)."""
    timed = testdata.timed_trips_from_orders(
        testdata.load(spark, sf_dir, "orders"), testdata.load(spark, sf_dir, "lineitem")
    )
    d = timed.select(duration_minutes(PICKUP, DROPOFF).alias("duration_min"))
    return _stable(describe(d, ["duration_min"], _PCTS))


@register(
    "passenger_counts",
    C.with_ctes(C.CTE_TRIPS)
    + """SELECT passenger_count, count(*) AS count FROM trips GROUP BY 1
ORDER BY passenger_count ASC NULLS LAST LIMIT 10""",
)
def q_passenger_counts(spark, sf_dir):
    """Passenger-count frequencies ordered by value, first 10."""
    return value_counts(C.trips(spark, sf_dir), "passenger_count", by="key", n=10)


@register(
    "payment_type_counts",
    C.with_ctes(C.CTE_TRIPS) + "SELECT payment_type, count(*) AS count FROM trips GROUP BY 1",
)
def q_payment_type_counts(spark, sf_dir):
    """Counts per payment type (event type), most frequent first."""
    return value_counts(C.trips(spark, sf_dir), "payment_type", by="count")
