"""The trip cube against the reports taken from the trips themselves."""

import datetime as dt

from pyspark.sql import functions as F

from slotwise.operators import explore as X
from slotwise.operators.cube import cells_of, marginals, trip_cube
from slotwise.operators.panel import hourly_demand, zone_filter_report
from slotwise.plans import common as C
from slotwise.schemas import HOUR, PICKUP, ZONE
from slotwise.session import configure
from tests.conftest import SF001, rows

SCHEMA = f"{ZONE} int, {PICKUP} timestamp_ntz, fare_amount double"


def trips_of(spark):
    at = [dt.datetime(2024, 1, d, h, 17) for d in (1, 2, 6) for h in (0, 5, 5, 23)]
    made = [(z, t, f) for z in (3, 4, 4, None) for t in [*at, None] for f in (1.0, -1.0, None)]
    return spark.createDataFrame(made, SCHEMA)


def test_reports_from_the_cube(spark):
    trips = trips_of(spark)
    cube = trip_cube(trips, {"negative": F.col("fare_amount") < 0}).cache()
    assert rows(cells_of(cube), ZONE, HOUR) == rows(hourly_demand(trips), ZONE, HOUR)
    assert rows(cells_of(cube, "negative"), ZONE, HOUR) == rows(hourly_demand(trips.filter("fare_amount < 0")), ZONE, HOUR)
    assert rows(X.peak_hour_and_zone(cube, HOUR, weight="trips")) == rows(X.peak_hour_and_zone(trips))
    assert rows(X.grid_coverage(cube, cells_of(cube), HOUR)) == rows(X.grid_coverage(trips, hourly_demand(trips)))
    assert rows(zone_filter_report(cells_of(cube), 3)) == rows(zone_filter_report(hourly_demand(trips), 3))


def test_marginals_add_up(spark):
    cube = trip_cube(trips_of(spark))
    got = marginals(cube).cache()
    n = trips_of(spark).count()
    assert {r["report"]: r["s"] for r in got.groupBy("report").agg(F.sum("trips").alias("s")).collect()} == dict.fromkeys(
        ["hour_of_day", "day_of_week", "date", ZONE, "hour_of_day+day_of_week", "all"], n
    )
    zones = {r[ZONE]: r["trips"] for r in got.filter(F.col("report") == ZONE).collect()}
    assert zones == {3: n // 4, 4: n // 2, None: n // 4}  # a null key is a value of its own


def test_no_trips(spark):
    cube = trip_cube(trips_of(spark).limit(0))
    assert cells_of(cube).count() == 0
    assert [(r["report"], r["trips"]) for r in marginals(cube).collect()] in ([], [("all", None)])


def test_cube_is_bounded_by_the_cells(spark):
    configure(spark)
    cube = C.cube(spark, SF001)
    assert cube.count() == C.trips(spark, SF001).select(ZONE, F.date_trunc("hour", PICKUP)).distinct().count()
