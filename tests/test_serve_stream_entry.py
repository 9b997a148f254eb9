import pytest
from pyspark.sql import functions as F

from slotwise.operators import serve as S
from slotwise.operators.lookup import build_lookup, require_keys
from slotwise.plans import common as C
from slotwise.session import configure
from slotwise.streaming.hourly import run_hourly_demand, shared_paths
from tests.conftest import SF001, SF01


def test_strict_predict_errors(spark):
    configure(spark)
    lookup = build_lookup(C.features(spark, SF001)).cache()
    zone = lookup.select(F.min("PULocationID")).first()[0]
    good = spark.createDataFrame([(zone, 8, 0, 0)], "PULocationID int, hour_of_day int, day_of_week int, is_weekend int")
    out = S.predict(good, lookup, "mean_demand_lag_168h", C.zones(spark, SF001), strict=True).collect()
    assert len(out) == 1 and out[0]["error_band"] == 3.62
    missing = spark.createDataFrame([(999999, 8, 0, 0)], good.schema)
    with pytest.raises(KeyError):
        S.predict(missing, lookup, "mean_demand_lag_168h", C.zones(spark, SF001), strict=True)
    with pytest.raises(KeyError):
        require_keys(missing, lookup)
    bad = spark.createDataFrame([(zone, 24, 0, 0)], good.schema)
    with pytest.raises(ValueError):
        S.predict(bad, lookup, "mean_demand_lag_168h", C.zones(spark, SF001), strict=True)
    # batch form skips keys without history
    both = good.unionByName(missing)
    assert S.predict(both, lookup, "mean_demand_lag_168h", C.zones(spark, SF001)).count() == 1


def test_request_frames(spark):
    assert S.day_requests(spark, 5, 2, 0).count() == 24
    wk = S.week_requests(spark, 5)
    assert wk.count() == 168 and wk.filter("is_weekend = 1").count() == 48


def test_stream_is_incremental(spark):
    configure(spark)
    sink, ck = shared_paths(spark, "test")
    run_hourly_demand(spark, SF01, sink, ck)
    first = spark.read.parquet(sink).count()
    run_hourly_demand(spark, SF01, sink, ck)  # no new files: nothing added
    assert spark.read.parquet(sink).count() == first > 0


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
