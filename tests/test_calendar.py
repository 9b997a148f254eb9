import datetime as dt

from pyspark.sql import functions as F

from slotwise.functions import calendar as K
from slotwise.functions.expressions import hour_label, pct_vs_typical, signed_pct_label


def test_calendar_columns(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2025, 1, 20, 8, 45, 30),), (dt.datetime(2025, 1, 25, 17, 5),), (dt.datetime(2025, 1, 1, 0, 0),)],
        "ts timestamp_ntz",
    )
    out = df.select(
        K.floor_hour("ts").alias("h"),
        K.hour_of_day("ts").alias("hod"),
        K.day_of_week("ts").alias("dow"),
        K.is_weekend(K.day_of_week("ts")).alias("we"),
        K.is_rush_hour(K.hour_of_day("ts"), K.day_of_week("ts")).alias("rush"),
        K.is_holiday("ts").alias("hol"),
        K.day_name("ts").alias("name"),
        K.month_of("ts").alias("m"),
    ).collect()
    assert out[0]["h"] == dt.datetime(2025, 1, 20, 8, 0)
    assert (out[0]["dow"], out[0]["we"], out[0]["rush"], out[0]["hol"], out[0]["name"]) == (0, 0, 1, 1, "Monday")
    assert (out[1]["dow"], out[1]["we"], out[1]["rush"], out[1]["name"]) == (5, 1, 0, "Saturday")
    assert (out[2]["hod"], out[2]["dow"], out[2]["hol"], out[2]["m"]) == (0, 2, 1, 1)
    assert dict(spark.createDataFrame([(1,)], "a int").select(K.floor_hour(F.lit("2025-03-09 02:30:00").cast("timestamp_ntz")).alias("x")).first().asDict())["x"] == dt.datetime(2025, 3, 9, 2, 0)


def test_duration_keeps_fractions(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1, 10, 0, 0), dt.datetime(2025, 1, 1, 10, 1, 30))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(K.duration_minutes("a", "b")).first()[0] == 1.5
    assert df.select(K.duration_minutes("b", "a")).first()[0] == -1.5


def test_weekday_to_forecast_date(spark):
    # the week after data ending 2025-02-01 runs Sunday Feb 2 .. Saturday Feb 8
    df = spark.range(7).select(F.col("id").cast("int").alias("dow"))
    got = dict(df.select("dow", K.weekday_to_date("dow", "2025-02-01").alias("d")).collect())
    assert got[0] == dt.date(2025, 2, 3) and got[6] == dt.date(2025, 2, 2) and got[5] == dt.date(2025, 2, 8)


def test_labels(spark):
    df = spark.createDataFrame([(0, 0.0), (12, 12.34), (13, -4.0), (23, 0.04)], "h int, p double")
    got = df.select(hour_label("h"), signed_pct_label("p")).collect()
    assert [tuple(r) for r in got] == [("12 AM", "0.0%"), ("12 PM", "+12.3%"), ("1 PM", "-4.0%"), ("11 PM", "+0.0%")]
    vs = spark.createDataFrame([(5.0, 4.0), (1.0, 0.0)], "p double, h double").select(pct_vs_typical("p", "h")).collect()
    assert [r[0] for r in vs] == [25.0, 0.0]
