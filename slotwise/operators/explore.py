"""Exploratory aggregates over trips, hourly cells and panels.

All of them are grouped aggregates with partial (map-side) aggregation; the
rankings and matrices are computed on the small aggregated results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.functions.calendar import calendar_date, day_name, day_of_week, floor_hour, hour_of_day
from slotwise.functions.expressions import pct, safe_corr, unbiased_skewness
from slotwise.schemas import HOUR, PICKUP, TARGET, ZONE


def _trips(weight: str | None) -> Column:
    """Number of trips: rows, or the sum of ``weight`` where a row stands for several (the trip cube)."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("trips")


def trips_by_hour(trips: DataFrame, ts_col: str = PICKUP, weight: str | None = None) -> DataFrame:
    """Trips per hour of day."""
    return trips.filter(F.col(ts_col).isNotNull()).groupBy(hour_of_day(ts_col).alias("hour_of_day")).agg(_trips(weight))


def trips_by_zone(trips: DataFrame, zone_col: str = ZONE, weight: str | None = None) -> DataFrame:
    """Trips per known pickup zone."""
    return trips.filter(F.col(zone_col).isNotNull()).groupBy(zone_col).agg(_trips(weight))


def trips_by_day_name(trips: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """Trips per weekday, with the day name and its Monday=0 order key."""
    return trips.filter(F.col(ts_col).isNotNull()).groupBy(
        day_of_week(ts_col).alias("day_of_week"), day_name(ts_col).alias("day_name")
    ).agg(F.count(F.lit(1)).alias("trips"))


def trips_by_date(trips: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """Trips per calendar date."""
    return trips.filter(F.col(ts_col).isNotNull()).groupBy(calendar_date(ts_col).alias("date")).agg(F.count(F.lit(1)).alias("trips"))


def with_zone_names(df: DataFrame, zones: DataFrame, zone_col: str = ZONE) -> DataFrame:
    """Attach zone name and borough; unknown ids fall back to
    ``Zone <id>`` / ``Unknown``.  The zone dimension is small and static, so
    Spark's size-checked auto broadcast applies."""
    z = zones.select(F.col("LocationID").alias("__loc"), "Zone", "Borough")
    out = df.join(z, df[zone_col] == z["__loc"], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.col("Zone"), F.concat(F.lit("Zone "), F.col(zone_col).cast("string"))).alias("zone_name"),
        F.coalesce(F.col("Borough"), F.lit("Unknown")).alias("borough"),
    )


def top_pickup_zones(trips: DataFrame, zones: DataFrame | None = None, n: int = 10, zone_col: str = ZONE) -> DataFrame:
    """The n busiest pickup zones (count desc, id asc) with names.

    The limit is applied before the name join, so only n rows are joined.
    """
    top = trips_by_zone(trips, zone_col).orderBy(F.desc("trips"), F.asc(zone_col)).limit(n)
    return with_zone_names(top, zones, zone_col) if zones is not None else top


def peak_hour_and_zone(trips: DataFrame, ts_col: str = PICKUP, zone_col: str = ZONE, weight: str | None = None) -> DataFrame:
    """Busiest hour of day and busiest zone, their trips and share (of trips, or of the cube with ``weight``).

    Ties go to the smallest key (``max_by`` over ``(count, -key)``).
    """
    by_hour = trips_by_hour(trips, ts_col, weight).agg(
        F.max_by("hour_of_day", F.struct("trips", -F.col("hour_of_day"))).alias("peak_hour"),
        F.max("trips").alias("peak_hour_trips"),
        F.sum("trips").alias("total"),
    )
    by_zone = (
        trips_by_zone(trips, zone_col, weight)
        .agg(F.max_by(F.struct(F.col(zone_col).alias("z"), F.col("trips").alias("t")), F.struct("trips", -F.col(zone_col))))
        .scalar()
    )
    both = by_hour.select("*", by_zone["z"].alias("top_zone"), by_zone["t"].alias("top_zone_trips"))
    return both.select(
        "peak_hour",
        "peak_hour_trips",
        F.round(pct(F.col("peak_hour_trips"), F.col("total")), 2).alias("peak_hour_pct"),
        "top_zone",
        "top_zone_trips",
        F.round(pct(F.col("top_zone_trips"), F.col("total")), 2).alias("top_zone_pct"),
    )


def weekday_hour_matrix(spark: SparkSession, trips: DataFrame, ts_col: str = PICKUP) -> DataFrame:
    """7 x 24 trip counts (rows Monday..Sunday, columns h00..h23), zero-filled."""
    keyed = trips.select(day_of_week(ts_col).alias("day_of_week"), hour_of_day(ts_col).alias("h"))
    wide = keyed.groupBy("day_of_week").pivot("h", list(range(24))).agg(F.count(F.lit(1)))
    days = spark.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    full = days.join(wide, "day_of_week", "left")
    return full.select(
        "day_of_week", *[F.coalesce(F.col(str(h)), F.lit(0)).cast("long").alias(f"h{h:02d}") for h in range(24)]
    )


def top_totals(cells: DataFrame, key: str, n: int = 10, target: str = TARGET) -> DataFrame:
    """The n keys with the largest summed demand (sum desc, key asc)."""
    return (
        cells.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.sum(target).alias("total_demand"))
        .orderBy(F.desc("total_demand"), F.asc(key))
        .limit(n)
    )


def demand_summary(cells: DataFrame, target: str = TARGET) -> DataFrame:
    """Min, median, mean, p95, max and bias-corrected skewness
    (exact quantiles computed without gathering values in one task)."""
    from slotwise.operators.quantiles import bracketed_quantiles

    x = F.col(target)
    median, p95 = (F.lit(v).cast("double") for v in bracketed_quantiles(cells, {target: [0.5, 0.95]})[target])
    one = cells.agg(
        F.min(x).alias("min"),
        F.avg(x).alias("mean"),
        F.max(x).alias("max"),
        unbiased_skewness(x).alias("skew"),
    )
    return one.select("min", median.alias("median"), "mean", p95.alias("p95"), "max", "skew")


def grid_coverage(trips: DataFrame, cells: DataFrame, ts_col: str = PICKUP, zone_col: str = ZONE) -> DataFrame:
    """Distinct hours and zones, full grid, observed and missing cells."""
    dims = trips.agg(
        F.count_distinct(floor_hour(ts_col)).alias("unique_hours"),
        F.count_distinct(zone_col).alias("unique_zones"),
    )
    observed = cells.agg(F.count(F.lit(1))).scalar()
    both = dims.select("*", observed.alias("observed_cells"))
    full = F.col("unique_hours") * F.col("unique_zones")
    return both.select(
        "unique_hours",
        "unique_zones",
        full.alias("full_grid"),
        "observed_cells",
        (full - F.col("observed_cells")).alias("missing_cells"),
        pct(F.col("observed_cells"), full).alias("coverage_pct"),
        pct(full - F.col("observed_cells"), full).alias("implied_zero_pct"),
    )


def mean_demand_by(cells: DataFrame, key: Column, name: str, target: str = TARGET) -> DataFrame:
    """Mean demand per key over *observed* cells (no zero rows)."""
    return cells.groupBy(key.alias(name)).agg(F.avg(target).alias("mean_demand"))


def daily_demand(cells: DataFrame, target: str = TARGET) -> DataFrame:
    """Total demand per calendar date."""
    return cells.groupBy(F.to_date(HOUR).alias("date")).agg(F.sum(target).alias("demand"))


def histogram(spark: SparkSession, df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed.

    Bounds are scalar subqueries; the bin list is joined so empty bins show
    as 0.  Output: ``bin, lower, upper, count``.
    """
    lo = df.select(F.min(col).cast("double")).scalar()
    hi = df.select(F.max(col).cast("double")).scalar()
    x = F.col(col).cast("double")
    scaled = F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))  # one value -> bin 1
    idx = F.least(F.floor(scaled * bins) + 1, F.lit(bins)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    return edges.join(counts, "bin", "left").select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("lower"),
        (lo + F.col("bin") * width).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


def unit_histogram(spark: SparkSession, df: DataFrame, col: str, lo: int = 0, hi: int = 11) -> DataFrame:
    """E20 (passenger variant): unit bins [k, k+1) for k in lo..hi-1, last bin closed."""
    x = F.col(col).cast("double")
    k = F.least(F.floor(x), F.lit(hi - 1)).cast("int")
    counts = df.filter((x >= lo) & (x <= hi)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(lo, hi).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select("bin", F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def abs_correlation_ranking(df: DataFrame, candidates: Sequence[str], target: str = TARGET) -> DataFrame:
    """|Pearson r| of each candidate with the target, strongest first.

    One pass over the data for all candidates; a constant candidate yields
    null rather than a division error.
    """
    one = df.agg(*[F.abs(safe_corr(c, target)).alias(c) for c in candidates])
    return one.unpivot([], list(candidates), "feature", "abs_corr").select(
        "feature", "abs_corr"
    ).orderBy(F.desc_nulls_last("abs_corr"), "feature")


def mutual_information_ranking(df: DataFrame, candidates: Sequence[str], target: str = TARGET) -> DataFrame:
    """Plug-in mutual information (nats) of discrete candidates with the
    target, strongest first.

    ``MI = H(X) + H(Y) - H(X,Y)``; with counts ``n``, ``n_x``, ``n_y``,
    ``n_xy`` that is ``ln n + (S_xy - S_x - S_y) / n`` where ``S = sum(c ln c)``.
    Every term is a grouped aggregate (partial aggregation, no window over a
    whole feature), and only one-row-per-feature results are joined.
    """
    stacked = df.select(
        F.col(target).cast("string").alias("y"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("x")) for c in candidates])
        ).alias("s"),
    ).select("s.feature", "s.x", "y")
    joint = stacked.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))

    def clnc(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("feature").agg(F.sum(F.col("c") * F.log("c")).alias(name))

    s_xy = joint.groupBy("feature").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s_xy"))
    s_x = clnc(joint.groupBy("feature", "x").agg(F.sum("c").alias("c")), "s_x")
    s_y = clnc(joint.groupBy("feature", "y").agg(F.sum("c").alias("c")), "s_y")
    parts = s_xy.join(s_x, "feature").join(s_y, "feature")
    mi = F.log("n") + (F.col("s_xy") - F.col("s_x") - F.col("s_y")) / F.col("n")
    return parts.select("feature", mi.alias("mutual_info")).orderBy(F.desc("mutual_info"), "feature")


def zero_share(df: DataFrame, group_cols: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Share of zero-target rows (%), non-zero rows and total rows."""
    y = F.col(target)
    grouped = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return grouped.agg(
        (F.avg((y == 0).cast("double")) * 100.0).alias("zero_pct"),
        F.count_if(y > 0).alias("n_nonzero"),
        F.count(F.lit(1)).alias("n_total"),
    )
