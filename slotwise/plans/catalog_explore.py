"""Registered queries: exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.calendar import day_of_week, hour_of_day, is_rush_hour, is_weekend, month_of
from slotwise.operators import explore as X
from slotwise.operators.cube import MARGINALS, TRIPS as TRIP_COUNT, cells_of, marginals
from slotwise.plans import common as C
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import EDA_RUSH_HOURS, HOUR, PICKUP, ZONE
from slotwise.sources import testdata

TRIPS = C.with_ctes(C.CTE_TRIPS)
CELLS = C.with_ctes(C.CTE_TRIPS, C.CTE_CLEAN, C.CTE_CELLS)
DOW = "CAST(isodow({}) - 1 AS INTEGER)"


@register("trips_by_hour", TRIPS + f"SELECT CAST(hour({PICKUP}) AS INTEGER) AS hour_of_day, count(*) AS trips FROM trips GROUP BY 1")
def q_trips_by_hour(spark, sf_dir):
    """Trips per hour of day."""
    return X.trips_by_hour(C.trips(spark, sf_dir))


@register(
    "trips_by_day_name",
    TRIPS
    + f"SELECT {DOW.format(PICKUP)} AS day_of_week, dayname({PICKUP}) AS day_name, count(*) AS trips FROM trips GROUP BY 1, 2",
)
def q_trips_by_day_name(spark, sf_dir):
    """Trips per weekday name (Monday=0 order key)."""
    return X.trips_by_day_name(C.trips(spark, sf_dir))


@register("trips_by_date", TRIPS + f"SELECT CAST({PICKUP} AS DATE) AS date, count(*) AS trips FROM trips GROUP BY 1")
def q_trips_by_date(spark, sf_dir):
    """Trips per calendar date."""
    return X.trips_by_date(C.trips(spark, sf_dir))


@register(
    "top_pickup_zones",
    C.with_ctes(C.CTE_TRIPS, testdata.ZONES_SQL)
    + f"""SELECT t.{ZONE}, t.trips, coalesce(z.Zone, 'Zone ' || CAST(t.{ZONE} AS VARCHAR)) AS zone_name,
  coalesce(z.Borough, 'Unknown') AS borough
FROM (SELECT {ZONE}, count(*) AS trips FROM trips GROUP BY 1 ORDER BY trips DESC, {ZONE} LIMIT 10) t
LEFT JOIN zones z ON t.{ZONE} = z.LocationID""",
)
def q_top_pickup_zones(spark, sf_dir):
    """E11 + D1: ten busiest pickup zones with names (fallback ``Zone n``)."""
    return X.top_pickup_zones(C.trips(spark, sf_dir), C.zones(spark, sf_dir))


@register(
    "peak_hour_zone",
    TRIPS
    + f"""SELECT h.peak_hour, h.peak_hour_trips, round(h.peak_hour_trips * 100.0 / h.total, 2) AS peak_hour_pct,
  z.top_zone, z.top_zone_trips, round(z.top_zone_trips * 100.0 / h.total, 2) AS top_zone_pct
FROM (SELECT arg_max(hour_of_day, (trips, -hour_of_day)) AS peak_hour, max(trips) AS peak_hour_trips, sum(trips) AS total
      FROM (SELECT CAST(hour({PICKUP}) AS INTEGER) AS hour_of_day, count(*) AS trips FROM trips GROUP BY 1)) h,
     (SELECT arg_max({ZONE}, (c, -{ZONE})) AS top_zone, max(c) AS top_zone_trips
      FROM (SELECT {ZONE}, count(*) AS c FROM trips GROUP BY 1)) z""",
)
def q_peak_hour_zone(spark, sf_dir):
    """Busiest hour and zone with their share of trips."""
    return X.peak_hour_and_zone(C.cube(spark, sf_dir), HOUR, weight=TRIP_COUNT)


_hcols = ", ".join(f"count(*) FILTER (WHERE h = {h}) AS h{h:02d}" for h in range(24))


@register(
    "weekday_hour_matrix",
    TRIPS
    + f"""SELECT d.day_of_week, {', '.join(f'coalesce(m.h{h:02d}, 0) AS h{h:02d}' for h in range(24))}
FROM (SELECT CAST(range AS INTEGER) AS day_of_week FROM range(7)) d
LEFT JOIN (SELECT {DOW.format(PICKUP)} AS day_of_week, {_hcols}
           FROM (SELECT *, hour({PICKUP}) AS h FROM trips) GROUP BY 1) m ON d.day_of_week = m.day_of_week""",
)
def q_weekday_hour_matrix(spark, sf_dir):
    """7 x 24 pickup counts, zero-filled, fixed axes."""
    return X.weekday_hour_matrix(spark, C.trips(spark, sf_dir))


@register(
    "top_zone_totals",
    CELLS + f"SELECT {ZONE}, CAST(sum(demand) AS BIGINT) AS total_demand FROM cells GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def q_top_zone_totals(spark, sf_dir):
    """Ten zones with the most demand, re-aggregated from hourly cells."""
    return X.top_totals(C.cells(spark, sf_dir), ZONE)


@register(
    "top_hour_totals",
    CELLS + "SELECT hour, CAST(sum(demand) AS BIGINT) AS total_demand FROM cells GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def q_top_hour_totals(spark, sf_dir):
    """Ten busiest clock hours, re-aggregated from hourly cells."""
    return X.top_totals(C.cells(spark, sf_dir), HOUR)


@register(
    "demand_summary",
    CELLS
    + """SELECT min(demand) AS min, quantile_cont(demand, 0.5) AS median, round(avg(demand), 6) AS mean,
  quantile_cont(demand, 0.95) AS p95, max(demand) AS max, round(skewness(demand), 6) AS skew FROM cells""",
)
def q_demand_summary(spark, sf_dir):
    """E15 + E16: distribution of hourly demand with bias-corrected skew."""
    return round_doubles(X.demand_summary(C.cells(spark, sf_dir)))


@register(
    "grid_coverage",
    CELLS
    + f"""SELECT unique_hours, unique_zones, unique_hours * unique_zones AS full_grid, observed_cells,
  unique_hours * unique_zones - observed_cells AS missing_cells,
  round(observed_cells * 100.0 / (unique_hours * unique_zones), 6) AS coverage_pct,
  round((unique_hours * unique_zones - observed_cells) * 100.0 / (unique_hours * unique_zones), 6) AS implied_zero_pct
FROM (SELECT count(DISTINCT date_trunc('hour', {PICKUP})) AS unique_hours, count(DISTINCT {ZONE}) AS unique_zones FROM clean),
     (SELECT count(*) AS observed_cells FROM cells)""",
)
def q_grid_coverage(spark, sf_dir):
    """How much of the zone x hour grid has any pickup."""
    cube = C.cube(spark, sf_dir)
    return round_doubles(X.grid_coverage(cube.filter("clean > 0"), cells_of(cube, "clean"), HOUR))


@register(
    "mean_demand_by_hour",
    CELLS + "SELECT CAST(hour(hour) AS INTEGER) AS hour_of_day, round(avg(demand), 6) AS mean_demand FROM cells GROUP BY 1",
)
def q_mean_demand_by_hour(spark, sf_dir):
    """Mean demand per hour of day over observed cells."""
    return round_doubles(X.mean_demand_by(C.cells(spark, sf_dir), hour_of_day(HOUR), "hour_of_day"))


@register(
    "mean_demand_by_weekday",
    CELLS + f"SELECT {DOW.format('hour')} AS day_of_week, round(avg(demand), 6) AS mean_demand FROM cells GROUP BY 1",
)
def q_mean_demand_by_weekday(spark, sf_dir):
    """Mean demand per weekday over observed cells."""
    return round_doubles(X.mean_demand_by(C.cells(spark, sf_dir), day_of_week(HOUR), "day_of_week"))


@register("daily_demand", CELLS + "SELECT CAST(hour AS DATE) AS date, CAST(sum(demand) AS BIGINT) AS demand FROM cells GROUP BY 1")
def q_daily_demand(spark, sf_dir):
    """Total demand per date."""
    return X.daily_demand(C.cells(spark, sf_dir))


@register(
    "demand_histogram",
    CELLS
    + """, b AS (SELECT CAST(min(demand) AS DOUBLE) AS lo, CAST(max(demand) AS DOUBLE) AS hi FROM cells),
h AS (SELECT CAST(least(floor(coalesce((demand - lo) / nullif(hi - lo, 0), 0.0) * 100) + 1, 100) AS INTEGER) AS bin,
             count(*) AS count FROM cells, b GROUP BY 1)
SELECT CAST(e.range AS INTEGER) AS bin, round(lo + (e.range - 1) * ((hi - lo) / 100), 6) AS lower,
       round(lo + e.range * ((hi - lo) / 100), 6) AS upper, coalesce(h.count, 0) AS count
FROM range(1, 101) e CROSS JOIN b LEFT JOIN h ON h.bin = e.range""",
)
def q_demand_histogram(spark, sf_dir):
    """100 equal-width bins of hourly demand."""
    return round_doubles(X.histogram(spark, C.cells(spark, sf_dir), "demand", 100))


@register(
    "passenger_histogram",
    TRIPS
    + """SELECT CAST(e.range AS INTEGER) AS bin, coalesce(h.count, 0) AS count FROM range(0, 11) e LEFT JOIN (
  SELECT CAST(least(floor(passenger_count), 10) AS INTEGER) AS bin, count(*) AS count FROM trips
  WHERE passenger_count >= 0 AND passenger_count <= 11 GROUP BY 1) h ON h.bin = e.range""",
)
def q_passenger_histogram(spark, sf_dir):
    """E20 (unit-bin variant): passenger counts 0..11 in unit bins."""
    return X.unit_histogram(spark, C.trips(spark, sf_dir), "passenger_count", 0, 11)


CANDIDATES = ["hour", "day_of_week", "month", "is_weekend", "is_rush_hour", ZONE]


def _eda_frame(spark, sf_dir):
    cells = C.cells(spark, sf_dir)
    hod, dow = hour_of_day(HOUR), day_of_week(HOUR)
    return cells.select(
        ZONE,
        "demand",
        hod.alias("hour"),
        dow.alias("day_of_week"),
        month_of(HOUR).alias("month"),
        is_weekend(dow).alias("is_weekend"),
        is_rush_hour(hod, dow, EDA_RUSH_HOURS).alias("is_rush_hour"),
    )


_EDA_SQL = CELLS + f""", eda AS (SELECT {ZONE}, demand, CAST(hour(hour) AS INTEGER) AS hour_x,
  {DOW.format('hour')} AS day_of_week, CAST(month(hour) AS INTEGER) AS month,
  CAST(isodow(hour) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(hour(hour) IN ({', '.join(map(str, EDA_RUSH_HOURS))}) AND isodow(hour) - 1 < 5 AS INTEGER) AS is_rush_hour FROM cells)
"""


def _corr_sql(c: str) -> str:
    x = "hour_x" if c == "hour" else c
    return (
        f"SELECT '{c}' AS feature, round(abs(covar_pop({x}, demand) / nullif(stddev_pop({x}) * stddev_pop(demand), 0)), 6)"
        f" AS abs_corr FROM eda"
    )


@register("correlation_ranking", _EDA_SQL + "\n UNION ALL ".join(_corr_sql(c) for c in CANDIDATES))
def q_correlation_ranking(spark, sf_dir):
    """|Pearson r| of calendar candidates with hourly demand (month is
    constant over one month, so its correlation is null)."""
    return round_doubles(X.abs_correlation_ranking(_eda_frame(spark, sf_dir), CANDIDATES))


def _mi_sql(c: str) -> str:
    x = "hour_x" if c == "hour" else c
    return f"""SELECT '{c}' AS feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS mutual_info FROM (
  SELECT nxy, sum(nxy) OVER (PARTITION BY x) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny, sum(nxy) OVER () AS n
  FROM (SELECT CAST({x} AS VARCHAR) AS x, CAST(demand AS VARCHAR) AS y, CAST(count(*) AS DOUBLE) AS nxy FROM eda GROUP BY 1, 2))"""


@register("mutual_info_ranking", _EDA_SQL + "\n UNION ALL ".join(_mi_sql(c) for c in CANDIDATES))
def q_mutual_info_ranking(spark, sf_dir):
    """E22 (re-aimed): plug-in mutual information of discrete candidates."""
    return round_doubles(X.mutual_information_ranking(_eda_frame(spark, sf_dir), CANDIDATES))


# ---------------------------------------------------------------------------
# The EDA summary table (metric, value) assembled from scalar aggregates
# ---------------------------------------------------------------------------
_STUDY = ("2024-01-01", "2024-02-01")


def _row(df):
    """A one-row aggregate as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns).alias("s")).scalar()


def _fmt_int(c):
    return F.format_number(c.cast("long"), 0)


def _fmt2(c):
    return F.format_string("%.2f", F.round(c.cast("double"), 2))


def eda_summary(spark, sf_dir):
    """Fourteen (metric, value) report rows from the quality and EDA aggregates."""
    from slotwise.functions.expressions import unbiased_skewness
    from slotwise.plans.catalog_quality import named_timed_trips

    columns = len(C.trips(spark, sf_dir).columns)
    cube = C.cube(spark, sf_dir)
    timed = named_timed_trips(spark, sf_dir)
    raw_cells = cells_of(cube)
    n, hour = F.col(TRIP_COUNT), F.col(HOUR)
    inside = (hour >= F.lit(_STUDY[0]).cast("timestamp_ntz")) & (hour < F.lit(_STUDY[1]).cast("timestamp_ntz"))  # whole hours
    t = _row(cube.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).alias("outside"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("bad_distance", "bad_dist"), ("negative_fare", "neg_fare"), ("bad_zone", "bad_zone"))],
        F.count_distinct(HOUR).alias("hours"),
        F.count_distinct(ZONE).alias("zones"),
    ))
    named = testdata.trips_with_zone_names(cube, C.zones(spark, sf_dir))
    unnamed = F.col("Zone").isNull() & F.col("Borough").isNull()
    nm = _row(named.agg(F.coalesce(F.sum(F.when(unnamed, n)), F.lit(0)).alias("k"), F.coalesce(F.sum(n), F.lit(0)).alias("n")))
    tm = _row(timed.agg(
        F.count_if(F.col("tpep_pickup_datetime") > F.col("tpep_dropoff_datetime")).alias("after"),
        F.count_if(F.col("tpep_dropoff_datetime") <= F.col("tpep_pickup_datetime")).alias("nonpos"),
        F.count_if(F.col("total_amount") < 0).alias("neg_total"),
    ))
    hz = _row(X.trips_by_hour(cube, HOUR, TRIP_COUNT).agg(
        F.max_by("hour_of_day", F.struct("trips", -F.col("hour_of_day"))).alias("h"), F.max("trips").alias("c")
    ))
    zz = _row(cube.groupBy(ZONE).agg(F.sum(n).alias("c")).agg(
        F.max_by(ZONE, F.struct("c", -F.col(ZONE))).alias("z"), F.max("c").alias("c")
    ))
    from slotwise.operators.quantiles import bracketed_quantiles

    d = F.col("demand")
    med, p95 = (F.lit(v).cast("double") for v in bracketed_quantiles(raw_cells, {"demand": [0.5, 0.95]})["demand"])
    cs = _row(raw_cells.agg(
        F.min(d).alias("mn"), F.avg(d).alias("mean"),
        F.max(d).alias("mx"), unbiased_skewness(d).alias("skew"), F.count(F.lit(1)).alias("obs"),
    ).select("*", med.alias("med"), p95.alias("p95")))
    full = t["hours"] * t["zones"]
    rows = [
        ("Raw dataset shape", F.concat(_fmt_int(t["n"]), F.lit(f" rows x {columns} columns"))),
        ("Rows outside January 2024", _fmt_int(t["outside"])),
        ("Repeated missingness (Zone/Borough)", F.concat(_fmt_int(nm["k"]), F.lit(" rows ("), _fmt2(nm["k"] * 100.0 / nm["n"]), F.lit("%) in each of Zone/Borough"))),
        ("Pickup after dropoff rows", _fmt_int(tm["after"])),
        ("Zero/negative duration rows", _fmt_int(tm["nonpos"])),
        ("Zero/negative trip distance rows", _fmt_int(t["bad_dist"])),
        ("Negative fare_amount rows", _fmt_int(t["neg_fare"])),
        ("Negative total_amount rows", _fmt_int(tm["neg_total"])),
        ("Invalid or missing PULocationID rows", _fmt_int(t["bad_zone"])),
        ("Top pickup zone concentration", F.concat(F.lit("Zone "), zz["z"].cast("string"), F.lit(": "), _fmt_int(zz["c"]), F.lit(" trips ("), _fmt2(zz["c"] * 100.0 / t["n"]), F.lit("%)"))),
        ("Peak hour-of-day concentration", F.concat(F.lpad(hz["h"].cast("string"), 2, "0"), F.lit(":00: "), _fmt_int(hz["c"]), F.lit(" trips ("), _fmt2(hz["c"] * 100.0 / t["n"]), F.lit("%)"))),
        ("Aggregated trip_count skew", F.concat(
            F.lit("min="), cs["mn"].cast("string"), F.lit(", median="), F.format_string("%.0f", F.round(cs["med"], 0)),
            F.lit(", mean="), F.format_string("%.1f", F.round(cs["mean"], 1)), F.lit(", 95th="), F.format_string("%.0f", F.round(cs["p95"], 0)),
            F.lit(", max="), cs["mx"].cast("string"), F.lit(", skew="), _fmt2(cs["skew"]))),
        ("Zone-hour observed coverage", F.concat(_fmt_int(cs["obs"]), F.lit(" / "), _fmt_int(full), F.lit(" ("), _fmt2(cs["obs"] * 100.0 / full), F.lit("%)"))),
        ("Zone-hour implied zero-demand share", F.concat(_fmt_int(full - cs["obs"]), F.lit(" / "), _fmt_int(full), F.lit(" ("), _fmt2((full - cs["obs"]) * 100.0 / full), F.lit("%)"))),
    ]
    one = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)])).alias("s")
    )
    return one.select("s.metric", "s.value")


def _eda_summary_sql() -> str:
    from slotwise.plans.catalog_quality import CTE_NAMED

    ctes = C.with_ctes(
        C.CTE_TRIPS, testdata.ZONES_SQL, CTE_NAMED,
        testdata.TIMED_TRIPS_SQL.replace("timed AS", "timed0 AS"),
        f"timed AS (SELECT t.*, z.Zone, z.Borough FROM timed0 t LEFT JOIN zones z ON t.{ZONE} = z.LocationID)",
        f"raw_cells AS (SELECT {ZONE}, date_trunc('hour', {PICKUP}) AS hour, count(*) AS demand FROM trips GROUP BY 1, 2)",
        f"""t AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE NOT ({PICKUP} >= TIMESTAMP '{_STUDY[0]}' AND {PICKUP} < TIMESTAMP '{_STUDY[1]}')) AS outside,
  count(*) FILTER (WHERE trip_distance <= 0) AS bad_dist, count(*) FILTER (WHERE fare_amount < 0) AS neg_fare,
  count(*) FILTER (WHERE {ZONE} IS NULL OR {ZONE} <= 0) AS bad_zone,
  count(DISTINCT date_trunc('hour', {PICKUP})) AS hours, count(DISTINCT {ZONE}) AS zones FROM trips)""",
        "nm AS (SELECT count(*) FILTER (WHERE Zone IS NULL AND Borough IS NULL) AS k, count(*) AS n FROM named)",
        """tm AS (SELECT count(*) FILTER (WHERE tpep_pickup_datetime > tpep_dropoff_datetime) AS after,
  count(*) FILTER (WHERE tpep_dropoff_datetime <= tpep_pickup_datetime) AS nonpos,
  count(*) FILTER (WHERE total_amount < 0) AS neg_total FROM timed)""",
        f"""hz AS (SELECT arg_max(h, (c, -h)) AS h, max(c) AS c FROM (
  SELECT CAST(hour({PICKUP}) AS INTEGER) AS h, count(*) AS c FROM trips GROUP BY 1))""",
        f"zz AS (SELECT arg_max(z, (c, -z)) AS z, max(c) AS c FROM (SELECT {ZONE} AS z, count(*) AS c FROM trips GROUP BY 1))",
        """cs AS (SELECT min(demand) AS mn, quantile_cont(demand, 0.5) AS med, avg(demand) AS mean,
  quantile_cont(demand, 0.95) AS p95, max(demand) AS mx, skewness(demand) AS skew, count(*) AS obs FROM raw_cells)""",
    )
    f2 = "printf('%.2f', round({}, 2))"
    fi = "format('{{:,}}', CAST({} AS BIGINT))"
    ncols = 7
    rows = [
        ("Raw dataset shape", f"{fi.format('t.n')} || ' rows x {ncols} columns'"),
        ("Rows outside January 2024", fi.format("t.outside")),
        ("Repeated missingness (Zone/Borough)", f"{fi.format('nm.k')} || ' rows (' || {f2.format('nm.k * 100.0 / nm.n')} || '%) in each of Zone/Borough'"),
        ("Pickup after dropoff rows", fi.format("tm.after")),
        ("Zero/negative duration rows", fi.format("tm.nonpos")),
        ("Zero/negative trip distance rows", fi.format("t.bad_dist")),
        ("Negative fare_amount rows", fi.format("t.neg_fare")),
        ("Negative total_amount rows", fi.format("tm.neg_total")),
        ("Invalid or missing PULocationID rows", fi.format("t.bad_zone")),
        ("Top pickup zone concentration", f"'Zone ' || zz.z || ': ' || {fi.format('zz.c')} || ' trips (' || {f2.format('zz.c * 100.0 / t.n')} || '%)'"),
        ("Peak hour-of-day concentration", f"lpad(CAST(hz.h AS VARCHAR), 2, '0') || ':00: ' || {fi.format('hz.c')} || ' trips (' || {f2.format('hz.c * 100.0 / t.n')} || '%)'"),
        ("Aggregated trip_count skew", "'min=' || cs.mn || ', median=' || printf('%.0f', round(cs.med, 0)) || ', mean=' || printf('%.1f', round(cs.mean, 1)) "
            "|| ', 95th=' || printf('%.0f', round(cs.p95, 0)) || ', max=' || cs.mx || ', skew=' || " + f2.format("cs.skew")),
        ("Zone-hour observed coverage", f"{fi.format('cs.obs')} || ' / ' || {fi.format('t.hours * t.zones')} || ' (' || {f2.format('cs.obs * 100.0 / (t.hours * t.zones)')} || '%)'"),
        ("Zone-hour implied zero-demand share", f"{fi.format('t.hours * t.zones - cs.obs')} || ' / ' || {fi.format('t.hours * t.zones')} || ' (' || {f2.format('(t.hours * t.zones - cs.obs) * 100.0 / (t.hours * t.zones)')} || '%)'"),
    ]
    sel = "\nUNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value FROM t, nm, tm, hz, zz, cs" for m, v in rows)
    return ctes + sel


register("eda_summary", _eda_summary_sql())(eda_summary)


_AXES_SQL = {"hour_of_day": f"CAST(hour({PICKUP}) AS INTEGER)", "day_of_week": DOW.format(PICKUP), "date": f"CAST({PICKUP} AS DATE)", ZONE: ZONE}


@register(
    "trip_marginals",
    TRIPS
    + ", m AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _AXES_SQL.items())
    + f", CAST({C.CLEAN_WHERE} AS INTEGER) AS ok FROM trips)\n"
    + "\nUNION ALL ".join(
        "SELECT '" + ("+".join(a for a in _AXES_SQL if a in s) or "all") + "' AS report, "
        + ", ".join(a if a in s else f"NULL AS {a}" for a in _AXES_SQL)
        + ", count(*) AS trips, CAST(coalesce(sum(ok), 0) AS BIGINT) AS clean FROM m" + (f" GROUP BY {', '.join(s)}" if s else "")
        for s in MARGINALS
    ),
)
def q_trip_marginals(spark, sf_dir):
    """E10, E11, E13, E14, E19 in one aggregate: the trip cube by grouping sets (hour, weekday, date, zone, weekday x hour, all)."""
    return marginals(C.cube(spark, sf_dir), [TRIP_COUNT, "clean"])
