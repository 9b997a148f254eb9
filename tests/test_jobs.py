"""End-to-end jobs: trip scan pruning, partition-pruned slices, tune + retrain."""

import contextlib
import datetime as dt
import io
import tempfile

from pyspark.sql import functions as F

from slotwise.operators import splits as SP
from slotwise.operators.quality import clean_trips
from slotwise.plans import common as C
from slotwise.plans.evaluation import score, tune_and_retrain
from slotwise.plans.feature_build import features_from_trips, run
from slotwise.profiles import TRIPS_JAN_2025
from slotwise.schemas import TRIP_SCHEMA
from slotwise.session import configure
from slotwise.sources.io import read_trips
from slotwise.sources.testdata import load, trips_from_events


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_trip_scan_prunes_and_pushes(spark):
    d = tempfile.mkdtemp(prefix="slotwise-trips-")
    base = dt.datetime(2025, 1, 6, 8, 15)
    rows = []
    for i in range(200):
        r = [None] * len(TRIP_SCHEMA.fields)
        vals = {
            "tpep_pickup_datetime": base + dt.timedelta(minutes=7 * i),
            "tpep_dropoff_datetime": base + dt.timedelta(minutes=7 * i + 12),
            "PULocationID": 100 + i % 3,
            "trip_distance": float(i % 60),
            "fare_amount": 3.0 + i % 250,
            "passenger_count": float(i % 8),
        }
        for j, f in enumerate(TRIP_SCHEMA.fields):
            r[j] = vals.get(f.name)
        rows.append(tuple(r))
    spark.createDataFrame(rows, TRIP_SCHEMA).write.parquet(d + "/trips")
    trips = read_trips(spark, d + "/trips")
    cleaned = clean_trips(trips, TRIPS_JAN_2025.rules).groupBy("PULocationID").count()
    plan = _plan(cleaned)
    assert "PushedFilters: [IsNotNull(trip_distance), IsNotNull(fare_amount), IsNotNull(passenger_count)" in plan
    read_schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "tip_amount" not in read_schema and "trip_distance" in read_schema
    feats = features_from_trips(trips, TRIPS_JAN_2025.__class__(**{**TRIPS_JAN_2025.__dict__, "min_active_hours": 1}))
    assert feats.count() > 0


def test_time_slice_prunes_date_partitions(spark):
    configure(spark)
    out = tempfile.mkdtemp(prefix="slotwise-slice-")
    trips = trips_from_events(load(spark, "/root/testdata/sf0.001", "events"))
    run(spark, trips, out + "/features", C.PROFILE)
    table = spark.read.parquet(out + "/features")
    sliced = SP.time_slice(table, "2024-01-22", "2024-01-29")
    assert "PartitionFilters: [isnotnull(date" in _plan(sliced)
    got = sliced.agg(F.min("hour"), F.max("hour")).first()
    assert got[0] == dt.datetime(2024, 1, 22) and got[1] == dt.datetime(2024, 1, 28, 23)


def test_tune_and_retrain_small_space(spark):
    configure(spark)
    feats = C.features(spark, "/root/testdata/sf0.001")
    space = {"trees": (5, 10, 5), "depth": (2, 4), "leaf": (1, 5)}
    trials, metrics, model = tune_and_retrain(feats, C.PROFILE, n_trials=2, max_bins=16, space=space)
    t = trials.collect()
    assert len(t) == 2 and t[0]["mean_cv_mae"] <= t[1]["mean_cv_mae"]
    assert {r["split"] for r in metrics.collect()} == {"val", "test"}
    assert score(model, feats).count() == feats.count()
