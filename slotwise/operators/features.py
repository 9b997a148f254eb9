"""Leakage-aware lag and rolling features.

All per-zone windows share one ordering ``(zone, hour)``; Spark plans them on
a single zone exchange (the panel's), so the whole feature build adds sorts,
not shuffles.  Every zone has the same number of rows after densifying, so
the window tasks are balanced however skewed the raw trips are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.operators.panel import FILL
from slotwise.schemas import HOUR, LAG_HOURS, ROLLING_HOURS, TARGET, ZONE


def _zone_window(zone_col: str):
    return Window.partitionBy(zone_col).orderBy(HOUR)


def add_lag_features(
    df: DataFrame, zone_col: str = ZONE, target: str = TARGET, lags: Iterable[int] = LAG_HOURS
) -> DataFrame:
    """``lag(target, n)`` within a zone; null for a zone's first n rows."""
    w = _zone_window(zone_col)
    return df.select(
        "*", *[F.lag(target, n).over(w).cast("double").alias(f"{target}_lag_{n}h") for n in lags]
    )


def fill_lag_nulls(
    df: DataFrame,
    zone_col: str = ZONE,
    target: str = TARGET,
    lags: Iterable[int] = LAG_HOURS,
    fill_until: str | None = None,
) -> DataFrame:
    """null lags -> mean demand of the zone at that hour of day.

    By default the mean spans the whole series (as the original pipeline
    does, which lets later hours inform early rows); ``fill_until`` restricts
    it to hours before a cutoff.
    """
    w = Window.partitionBy(zone_col, "hour_of_day")
    src = F.col(target)
    if fill_until is not None:
        src = F.when(F.col(HOUR) < F.lit(fill_until).cast("timestamp_ntz"), src)
    fill = F.avg(src).over(w)
    cols = {f"{target}_lag_{n}h" for n in lags}
    return df.select(
        *[F.coalesce(F.col(c), fill).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def add_rolling_features(
    df: DataFrame, zone_col: str = ZONE, target: str = TARGET, windows: Iterable[int] = ROLLING_HOURS
) -> DataFrame:
    """mean of the previous n rows (current row excluded), partial windows
    allowed, 0 for a zone's first row.

    Computed from growing frames instead of a sliding one (R3): the sum of
    the previous n rows is ``sum(..-1) - sum(..-(n+1))``, both running sums
    that advance O(1) per row, while a sliding ``avg`` re-reads its frame for
    every row.  Demand is integral so the sums are exact, and all frames share
    the (zone, hour) sort of the lag columns.
    """
    w = _zone_window(zone_col)
    upto = lambda k: F.coalesce(F.sum(target).over(w.rowsBetween(Window.unboundedPreceding, -k)), F.lit(0))
    prev = F.row_number().over(w) - 1
    outs = []
    for n in windows:
        cnt = F.least(prev, F.lit(n))
        window_sum = upto(1) - upto(n + 1)
        outs.append(
            F.when(cnt > 0, window_sum.cast("double") / cnt).otherwise(F.lit(0.0)).alias(f"{target}_rolling_{n}h")
        )
    return df.select("*", *outs)


def add_rolling_features_sliding(
    df: DataFrame, zone_col: str = ZONE, target: str = TARGET, windows: Iterable[int] = ROLLING_HOURS
) -> DataFrame:
    """F3 written with sliding frames; kept to check R3 against."""
    w = _zone_window(zone_col)
    return df.select(
        "*",
        *[
            F.coalesce(F.avg(target).over(w.rowsBetween(-n, -1)), F.lit(0.0)).alias(f"{target}_rolling_{n}h")
            for n in windows
        ],
    )


def build_features(
    panel: DataFrame,
    zone_col: str = ZONE,
    target: str = TARGET,
    fill_until: str | None = None,
) -> DataFrame:
    """F1 -> F2 -> F3 on a dense panel: the full feature table.

    A panel built ``with_fill`` brings the fill mean of every row; the panel is
    then sorted once, by (zone, hour), for the join, the lags and the rolling
    sums.  Any other panel gets it from a window on (zone, hour_of_day).  All
    windows run on the panel's zone partitioning without another exchange.
    """
    with_fill = panel
    if FILL not in panel.columns:
        fill = Window.partitionBy(zone_col, "hour_of_day")
        src = F.col(target)
        if fill_until is not None:
            src = F.when(F.col(HOUR) < F.lit(fill_until).cast("timestamp_ntz"), src)
        with_fill = panel.select("*", F.avg(src).over(fill).alias(FILL))
    w = _zone_window(zone_col)
    lagged = with_fill.select(
        *[c for c in panel.columns if c != FILL],
        *[
            F.coalesce(F.lag(target, n).over(w).cast("double"), F.col(FILL)).alias(f"{target}_lag_{n}h")
            for n in LAG_HOURS
        ],
    )
    return add_rolling_features(lagged, zone_col, target)
