"""Calendar expressions (all JVM-side built-ins, no UDFs).

Timestamps are ``TIMESTAMP_NTZ`` (local wall-clock time of the data source).
``date_trunc`` returns ``TIMESTAMP`` even for NTZ input, so every floor is
cast back.  ``weekday`` is Monday=0 (``dayofweek`` is Sunday=1 and wrong
here).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.schemas import DAY_NAMES, HOLIDAYS_JAN_2025, HOUR, RUSH_HOURS


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col: str | Column) -> Column:
    """B1: idempotent cast to a wall-clock timestamp."""
    return _c(col).cast("timestamp_ntz")


def floor_hour(col: str | Column) -> Column:
    """B2: floor to the hour, staying ``TIMESTAMP_NTZ``."""
    return F.date_trunc("hour", _c(col)).cast("timestamp_ntz")


def hour_of_day(col: str | Column) -> Column:
    """0-23."""
    return F.hour(_c(col))


def day_of_week(col: str | Column) -> Column:
    """Monday=0 .. Sunday=6."""
    return F.weekday(_c(col))


def month_of(col: str | Column) -> Column:
    """1-12."""
    return F.month(_c(col))


def is_weekend(dow: str | Column) -> Column:
    """Saturday or Sunday as 0/1."""
    return (_c(dow) >= 5).cast("int")


def is_rush_hour(hour: str | Column, dow: str | Column, hours: Iterable[int] = RUSH_HOURS) -> Column:
    """Weekday rush hour as 0/1; the hour set is a parameter."""
    return (_c(hour).isin(*list(hours)) & (_c(dow) < 5)).cast("int")


def is_holiday(ts: str | Column, holidays: Iterable[str] = HOLIDAYS_JAN_2025) -> Column:
    """Calendar date in the holiday set as 0/1.

    The set is a short literal list, so an ``In`` predicate beats a join.
    """
    dates = [F.lit(d).cast("date") for d in holidays]
    if not dates:
        return F.lit(0)
    return F.to_date(_c(ts)).isin(*dates).cast("int")


def duration_minutes(start: str | Column, end: str | Column) -> Column:
    """Fractional minutes between two timestamps (negative if reversed)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(60_000_000.0)


def day_name(ts: str | Column) -> Column:
    """Full day name; pair it with :func:`day_of_week` for ordering."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), day_of_week(ts) + 1)


def calendar_date(ts: str | Column) -> Column:
    """B11."""
    return F.to_date(_c(ts))


def with_calendar(
    df: DataFrame,
    ts_col: str = HOUR,
    holidays: Iterable[str] = HOLIDAYS_JAN_2025,
    rush_hours: Iterable[int] = RUSH_HOURS,
) -> DataFrame:
    """Append hour_of_day, day_of_week, is_weekend, is_rush_hour, is_holiday."""
    hod = hour_of_day(ts_col)
    dow = day_of_week(ts_col)
    return df.select(
        "*",
        hod.alias("hour_of_day"),
        dow.alias("day_of_week"),
        is_weekend(dow).alias("is_weekend"),
        is_rush_hour(hod, dow, rush_hours).alias("is_rush_hour"),
        is_holiday(ts_col, holidays).alias("is_holiday"),
    )


def weekday_to_date(dow: str | Column, end_date: str | Column) -> Column:
    """First date strictly after ``end_date`` falling on weekday ``dow``."""
    end = F.to_date(_c(end_date)) if not isinstance(end_date, str) else F.to_date(F.lit(end_date))
    return F.date_add(end, F.pmod(_c(dow) - F.weekday(end) - 1, F.lit(7)) + 1)
