"""Hourly demand and the dense zone-by-hour panel.

Plan shape (see ``build_panel``):

1. ``hourly_demand``: partial + final hash aggregate on (zone, hour).  Map-side
   combine means a zone holding a third of all trips still ships only one
   row per (zone, hour, map task).
2. The aggregated cells are checkpointed (one scan of the trips for all
   consumers), then hash-partitioned by zone: one zone shuffle of the small
   cell table feeds the activity count (and so the grid), one feeds the join
   side.  The grid join and every per-zone window downstream reuse that zone
   partitioning: no exchange over the panel itself.
3. The calendar bounds are two scalar subqueries over the cells (one tiny
   merged aggregate), and the grid is ``explode(sequence(lo, hi, 1 hour))``
   per active zone: a map-side Generate, no cross join, nothing collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.calendar import floor_hour, with_calendar
from slotwise.session import cut_lineage
from slotwise.schemas import HOLIDAYS_JAN_2025, HOUR, MIN_ACTIVE_HOURS, PICKUP, RUSH_HOURS, TARGET, ZONE

#: Columns that carry F2's fill means: 24 per zone, and the one of a row's hour of day.
FILLS, FILL = "__fills", "__fill"


def hourly_demand(
    trips: DataFrame, zone_col: str = ZONE, ts_col: str = PICKUP, target: str = TARGET
) -> DataFrame:
    """Trips per (zone, hour) over observed cells only; rows without zone or time belong to no cell."""
    keyed = trips.filter(F.col(zone_col).isNotNull() & F.col(ts_col).isNotNull())
    return keyed.groupBy(F.col(zone_col).alias(zone_col), floor_hour(ts_col).alias(HOUR)).agg(
        F.count(F.lit(1)).alias(target)
    )


def zone_activity(cells: DataFrame, zone_col: str = ZONE, target: str = TARGET) -> DataFrame:
    """Active hours (rows with demand > 0) per zone."""
    return cells.groupBy(zone_col).agg(F.count_if(F.col(target) > 0).alias("active_hours"))


def active_zones(
    cells: DataFrame, min_active_hours: int = MIN_ACTIVE_HOURS, zone_col: str = ZONE, target: str = TARGET
) -> DataFrame:
    """Zones with at least ``min_active_hours`` hours of positive demand."""
    return (
        zone_activity(cells, zone_col, target)
        .filter(F.col("active_hours") >= min_active_hours)
        .select(zone_col)
    )


def dropped_zones(
    cells: DataFrame, min_active_hours: int = MIN_ACTIVE_HOURS, zone_col: str = ZONE, target: str = TARGET
) -> DataFrame:
    """Zones removed by C5 with their active-hour counts."""
    return zone_activity(cells, zone_col, target).filter(F.col("active_hours") < min_active_hours)


def zone_filter_report(
    cells: DataFrame, min_active_hours: int = MIN_ACTIVE_HOURS, zone_col: str = ZONE, target: str = TARGET
) -> DataFrame:
    """C5 report: zones and dense-panel rows before / after the activity
    filter, dropped zones, and zero-demand rows kept (count and %).

    Computed from the observed cells alone: a dense panel has
    ``zones x calendar hours`` rows, and every missing cell is a zero row.
    """
    lo, hi = hour_bounds(cells)
    hours = F.timestamp_diff("HOUR", lo, hi) + 1
    per_zone = zone_activity(cells, zone_col, target)
    one = per_zone.agg(
        F.count(F.lit(1)).alias("zones_before"),
        F.count_if(F.col("active_hours") >= min_active_hours).alias("zones_after"),
        F.sum(F.when(F.col("active_hours") >= min_active_hours, F.col("active_hours"))).alias("nonzero_after"),
    )
    rows_after = F.col("zones_after") * hours
    zero_after = rows_after - F.coalesce(F.col("nonzero_after"), F.lit(0))
    return one.select(
        "zones_before",
        "zones_after",
        (F.col("zones_before") - F.col("zones_after")).alias("zones_dropped"),
        (F.col("zones_before") * hours).alias("rows_before"),
        rows_after.alias("rows_after"),
        zero_after.alias("zero_rows_kept"),
        F.try_divide(zero_after * 100.0, rows_after).alias("zero_pct"),
    )


def hour_bounds(cells: DataFrame, hour_col: str = HOUR) -> tuple:
    """Global first and last hour as scalar-subquery columns (no action)."""
    both = cells.select(F.struct(F.min(hour_col).alias("lo"), F.max(hour_col).alias("hi"))).scalar()
    return both["lo"], both["hi"]


def _hour_column(value) -> F.Column:
    return value if isinstance(value, F.Column) else F.lit(str(value)).cast("timestamp_ntz")


def calendar_grid(zones: DataFrame, lo, hi, zone_col: str = ZONE) -> DataFrame:
    """Every zone times every hour in ``[lo, hi]``.

    ``lo``/``hi`` are columns (scalar subqueries) or literal timestamps; the
    product is generated per zone row, so it is spread over the zones'
    partitions and keeps their partitioning.  Zones that carry their fill means
    (:func:`zone_fills`) give each row the mean of its hour of day as ``__fill``.
    """
    carried = [FILLS] if FILLS in zones.columns else []
    grid = zones.select(
        zone_col, *carried, F.explode(F.sequence(_hour_column(lo), _hour_column(hi), F.expr("INTERVAL 1 HOUR"))).alias(HOUR)
    )
    if not carried:
        return grid
    return grid.select(zone_col, HOUR, F.element_at(FILLS, F.hour(HOUR) + 1).alias(FILL))


def zone_fills(
    cells: DataFrame,
    lo,
    hi,
    min_active_hours: int = MIN_ACTIVE_HOURS,
    zone_col: str = ZONE,
    target: str = TARGET,
    fill_until: str | None = None,
) -> DataFrame:
    """Active zones (C5) with their 24 fill means (F2) as one array, from the cells.

    The mean demand of a zone at an hour of day over the dense calendar is the sum
    over its observed cells divided by the number of calendar hours ``[lo, hi]``
    with that hour of day, so the dense panel needs no window for it.  With
    ``fill_until`` only hours before it count; without such hours the mean is null.
    """
    counted = F.lit(True) if fill_until is None else F.col(HOUR) < _hour_column(fill_until)
    by_hour = cells.groupBy(zone_col, F.hour(HOUR).alias("__h")).agg(
        F.count_if(F.col(target) > 0).alias("__active"), F.sum(F.when(counted, F.col(target))).alias("__sum")
    )
    per_zone = by_hour.groupBy(zone_col).agg(
        F.sum("__active").alias("__active"), F.map_from_entries(F.collect_list(F.struct("__h", "__sum"))).alias("__sums")
    ).filter(F.col("__active") >= min_active_hours)
    last = _hour_column(hi)
    if fill_until is not None:
        last = F.least(last, _hour_column(fill_until) - F.expr("INTERVAL 1 HOUR"))
    spanned = per_zone.select(zone_col, "__sums", _hour_column(lo).alias("__lo"), last.alias("__last")).select(
        zone_col, "__sums", F.hour("__lo").alias("__start"), F.timestamp_diff("HOUR", F.col("__lo"), F.col("__last")).alias("__span")
    )

    def mean(h: F.Column) -> F.Column:
        times = F.floor((F.col("__span") - F.pmod(h - F.col("__start"), F.lit(24))) / 24.0) + 1
        return F.try_divide(F.coalesce(F.col("__sums")[h], F.lit(0)).cast("double"), F.greatest(times, F.lit(0)))

    return spanned.select(zone_col, F.transform(F.sequence(F.lit(0), F.lit(23)), mean).alias(FILLS))


def fill_missing_hours(
    cells: DataFrame,
    zones: DataFrame | None = None,
    lo=None,
    hi=None,
    zone_col: str = ZONE,
    target: str = TARGET,
    holidays: Iterable[str] = HOLIDAYS_JAN_2025,
    rush_hours: Iterable[int] = RUSH_HOURS,
) -> DataFrame:
    """D3: reindex every zone to the full hourly calendar, demand 0 if absent.

    ``zones`` defaults to all zones present in ``cells`` and the bounds to
    the global range of ``cells``.  Calendar columns are derived once on the
    dense result.
    """
    if lo is None or hi is None:
        lo, hi = hour_bounds(cells)
    if zones is None:
        zones = cells.select(zone_col).distinct()
    grid = calendar_grid(zones, lo, hi, zone_col)
    carried = [FILL] if FILL in grid.columns else []
    dense = grid.join(cells, [zone_col, HOUR], "left").select(
        zone_col, HOUR, F.coalesce(F.col(target), F.lit(0)).cast("long").alias(target), *carried
    )
    return with_calendar(dense, HOUR, holidays, rush_hours)


def build_panel(
    trips: DataFrame,
    min_active_hours: int = MIN_ACTIVE_HOURS,
    zone_col: str = ZONE,
    ts_col: str = PICKUP,
    target: str = TARGET,
    holidays: Iterable[str] = HOLIDAYS_JAN_2025,
    rush_hours: Iterable[int] = RUSH_HOURS,
    materialize: bool = True,
    with_fill: bool = False,
    fill_until: str | None = None,
) -> DataFrame:
    """E0 -> C5 -> D2 -> D3 with the inactive-zone filter moved first.

    The calendar range is taken over *all* zones before any is dropped, as
    in the sequential pipeline; because zero-filled rows never count as
    active, filtering before densifying gives the same rows.

    The aggregated cells feed three consumers (calendar bounds, activity
    count, grid join).  With ``materialize`` they are checkpointed once to
    the shared checkpoint folder: the raw trips are scanned a single time and
    a lost executor re-reads the small cell table instead of rescanning
    trips.  Both join sides are then hash-partitioned by zone, which also
    serves every per-zone window of the feature build.

    ``with_fill`` adds the fill mean of every row (``__fill``, see
    :func:`zone_fills`), which ``build_features`` then uses instead of a window.
    """
    cells = hourly_demand(trips, zone_col, ts_col, target)
    if materialize:
        cells = cut_lineage(cells)
    lo, hi = hour_bounds(cells)
    by_zone = cells.repartition(zone_col)
    if with_fill:
        keep = zone_fills(by_zone, lo, hi, min_active_hours, zone_col, target, fill_until)
    else:
        keep = active_zones(by_zone, min_active_hours, zone_col, target)
    return fill_missing_hours(by_zone, keep, lo, hi, zone_col, target, holidays, rush_hours)


def panel_sequential(
    trips: DataFrame,
    min_active_hours: int = MIN_ACTIVE_HOURS,
    zone_col: str = ZONE,
    ts_col: str = PICKUP,
    holidays: Iterable[str] = HOLIDAYS_JAN_2025,
) -> DataFrame:
    """Reference order (densify all zones, then drop inactive ones).

    Kept to prove R1: ``build_panel`` must return exactly these rows.
    """
    cells = hourly_demand(trips, zone_col, ts_col)
    dense = fill_missing_hours(cells, zone_col=zone_col, holidays=holidays)
    keep = active_zones(dense, min_active_hours, zone_col)
    return dense.join(keep, zone_col, "left_semi")


def panel_profile(panel: DataFrame, zone_col: str = ZONE, target: str = TARGET) -> DataFrame:
    """One-row run profile of a panel or feature table."""
    null_counts = [
        F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in panel.columns if c not in (zone_col, HOUR)
    ]
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(zone_col).alias("zones"),
        F.min(HOUR).alias("min_hour"),
        F.max(HOUR).alias("max_hour"),
        F.count_if(F.col(target) == 0).alias("zero_rows"),
        (F.avg((F.col(target) == 0).cast("double")) * 100.0).alias("zero_pct"),
        *null_counts,
    )
