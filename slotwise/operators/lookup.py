"""Historical lookup table and request joins.

The lookup holds one row per (zone, hour of day, day of week): at most
zones x 168 rows, so it is bounded by the zone dimension, not by the data
volume.  Joins against it are left to Spark's size-checked broadcast
(``autoBroadcastJoinThreshold`` on scans, AQE's runtime threshold on shuffle
outputs); beyond the threshold they fall back to a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.schemas import HOUR, TARGET, ZONE

LOOKUP_SOURCES = [
    TARGET,
    "demand_lag_1h",
    "demand_lag_24h",
    "demand_lag_168h",
    "demand_rolling_3h",
    "demand_rolling_168h",
]
KEYS = [ZONE, "hour_of_day", "day_of_week"]


def build_lookup(
    features: DataFrame, as_of: str | None = None, zone_col: str = ZONE, digits: int | None = None
) -> DataFrame:
    """Mean of demand and the five lag/rolling columns per key.

    ``as_of`` restricts the history to hours before a cutoff (the original
    pipeline averages over every row).  ``digits`` rounds the means: averages
    of doubles depend on the summation order in their last bits, and reports
    that compare engines bit by bit ask for 9 digits.
    """
    src = features
    if as_of is not None:
        src = src.filter(F.col(HOUR) < F.lit(as_of).cast("timestamp_ntz"))
    keys = [zone_col, "hour_of_day", "day_of_week"]
    return src.groupBy(*keys).agg(*[(F.avg(c) if digits is None else F.round(F.avg(c), digits)).alias(f"mean_{c}") for c in LOOKUP_SOURCES])


def attach_lookup(requests: DataFrame, lookup: DataFrame, zone_col: str = ZONE) -> DataFrame:
    """Requests with their lookup means; keys without history are skipped."""
    keys = [zone_col, "hour_of_day", "day_of_week"]
    return requests.join(lookup, keys, "inner")


def missing_keys(requests: DataFrame, lookup: DataFrame, zone_col: str = ZONE) -> DataFrame:
    """Requests whose key has no history."""
    keys = [zone_col, "hour_of_day", "day_of_week"]
    return requests.join(lookup.select(*keys), keys, "left_anti")


def require_keys(requests: DataFrame, lookup: DataFrame, zone_col: str = ZONE, show: int = 5) -> DataFrame:
    """D5 (strict): raise ``KeyError`` listing up to ``show`` missing keys."""
    missing = missing_keys(requests, lookup, zone_col).limit(show).collect()
    if missing:
        raise KeyError(f"no historical data for {[tuple(r) for r in missing]}")
    return attach_lookup(requests, lookup, zone_col)
