"""One cube of the raw trips for the exploratory reports (E10-E14, E17, E19, E25, C5 report).

The cube has one row per observed (zone, hour), null keys included, with the number of
trips and how many of them meet each named condition.  It is at most zones x hours of the
calendar in size, whatever the number of trips; it is built by one scan of the trips with
partial aggregation, and every report aggregates the cube again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import calendar_date, day_of_week, floor_hour, hour_of_day
from slotwise.schemas import HOUR, PICKUP, TARGET, ZONE

TRIPS = "trips"
#: Report axes of :func:`marginals`.
AXES = ("hour_of_day", "day_of_week", "date", ZONE)
MARGINALS = (("hour_of_day",), ("day_of_week",), ("date",), (ZONE,), ("day_of_week", "hour_of_day"), ())


def trip_cube(trips: DataFrame, conditions: Mapping[str, Column] | None = None, zone_col: str = ZONE, ts_col: str = PICKUP) -> DataFrame:
    """(zone, hour, trips, *conditions): trips of each cell, and those that meet each condition (null does not)."""
    return trips.groupBy(F.col(zone_col).alias(ZONE), floor_hour(ts_col).alias(HOUR)).agg(
        F.count(F.lit(1)).alias(TRIPS), *[F.count_if(c).alias(name) for name, c in (conditions or {}).items()]
    )


def cells_of(cube: DataFrame, measure: str = TRIPS) -> DataFrame:
    """E0 from the cube: observed cells with ``measure`` as demand; null keys belong to no cell."""
    return cube.filter(F.col(ZONE).isNotNull() & F.col(HOUR).isNotNull() & (F.col(measure) > 0)).select(
        ZONE, HOUR, F.col(measure).alias(TARGET)
    )


def marginals(cube: DataFrame, measures: Sequence[str] = (TRIPS,), sets: Sequence[Sequence[str]] = MARGINALS) -> DataFrame:
    """All reports in one aggregate: a row per value of each set of axes, with the sums of the measures.

    ``report`` names the axes of the row (``all`` for the total); axes outside it are null.
    A null key of the cube is a value like any other.
    """
    axes = list(AXES)
    keyed = cube.select(
        hour_of_day(HOUR).alias("hour_of_day"), day_of_week(HOUR).alias("day_of_week"), calendar_date(HOUR).alias("date"), ZONE, *measures
    )
    inside = [F.when(F.grouping(a) == 0, F.lit(a)) for a in axes]
    grouped = keyed.groupingSets([[F.col(a) for a in s] for s in sets], *[F.col(a) for a in axes])
    sums = grouped.agg(F.concat_ws("+", *inside).alias("report"), *[F.sum(m).alias(m) for m in measures])
    return sums.select(F.when(F.col("report") == "", "all").otherwise(F.col("report")).alias("report"), *axes, *measures)
