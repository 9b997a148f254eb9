"""Operators return exact values; keys that are null belong to no group; independent weekend flag; trip types."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.expressions import unbiased_skewness
from slotwise.operators.explore import top_pickup_zones, trips_by_hour
from slotwise.operators.panel import hourly_demand, zone_activity
from slotwise.operators.quality import describe
from slotwise.plans.registry import QUERIES, load_all
from slotwise.schemas import PICKUP, TRIP_SCHEMA, ZONE
from slotwise.sources.io import read_trips

SF001 = "/root/testdata/sf0.001"


def test_describe_is_exact(spark):
    df = spark.createDataFrame([(1.0,), (12_345_678_901_237.0,), (3.123456789012,)], "x double")
    got = {r.statistic: r.value for r in describe(df, ["x"], (0.5,)).collect()}
    assert got["count"] == 3 and got["min"] == 1.0 and got["max"] == 12_345_678_901_237.0 and got["p50"] == 3.123456789012


def test_null_keys_are_in_no_cell(spark):
    t = dt.datetime(2025, 1, 1, 5, 30)
    trips = spark.createDataFrame([(1, t), (None, t), (1, None), (2, t), (1, t)], f"{ZONE} int, {PICKUP} timestamp_ntz")
    cells = {(r[0], r[1]): r[2] for r in hourly_demand(trips).collect()}
    hour = dt.datetime(2025, 1, 1, 5)
    assert cells == {(1, hour): 2, (2, hour): 1}
    assert {r[0] for r in zone_activity(hourly_demand(trips)).collect()} == {1, 2}
    assert [(r.hour_of_day, r.trips) for r in trips_by_hour(trips).collect()] == [(5, 4)]
    assert [(r[0], r[1]) for r in top_pickup_zones(trips).collect()] == [(1, 3), (2, 1)]


def test_skew_of_a_constant_column(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "x double")
    assert df.agg(unbiased_skewness("x")).first()[0] == 0.0
    assert df.limit(2).agg(unbiased_skewness("x")).first()[0] is None


@pytest.mark.parametrize("kind", [T.IntegerType(), T.LongType(), T.DoubleType()])
def test_trip_scan_reads_any_numeric_type(spark, tmp_path, kind):
    fields = [T.StructField(f.name, kind if f.name in ("passenger_count", "payment_type", ZONE) else f.dataType) for f in TRIP_SCHEMA.fields]
    one = {T.IntegerType: 1, T.LongType: 1, T.DoubleType: 1.0}[type(kind)]
    values = []
    for f in fields:
        base = f.dataType
        values.append(one if base == kind else dt.datetime(2025, 1, 1) if isinstance(base, T.TimestampNTZType) else "N" if isinstance(base, T.StringType) else 1.0 if isinstance(base, T.DoubleType) else 1)
    path = str(tmp_path / "trips")
    spark.createDataFrame([tuple(values)], T.StructType(fields)).write.parquet(path)
    got = read_trips(spark, path)
    assert got.schema.simpleString() == TRIP_SCHEMA.simpleString() and got.count() == 1
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks trip columns"):
        read_trips(spark, str(tmp_path / "bad"))


def test_weekend_flag_changes_the_forecast(spark):
    load_all()
    rows = QUERIES["weekend_contrast"](spark, SF001).collect()
    assert rows and all(r.zone_a == r.zone_b for r in rows)
    assert any(abs(r.difference) > 1e-6 for r in rows)
