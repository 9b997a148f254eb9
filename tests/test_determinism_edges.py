"""Same results under 1, 4 and 16 shuffle partitions; edge cases of helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotwise.operators import explore as X
from slotwise.operators import metrics as ME
from slotwise.operators import serve as S
from slotwise.operators.lookup import build_lookup
from slotwise.plans.registry import QUERIES, load_all
from slotwise.session import configure
from tests.conftest import SF001

load_all()
ORDER_SENSITIVE = ["random_split", "shuffled_folds", "time_positions", "zone_ranks", "top_zones", "time_series_folds"]


@pytest.fixture(scope="module")
def baseline(spark):
    configure(spark)
    return {n: sorted(map(tuple, QUERIES[n](spark, SF001).collect()), key=repr) for n in ORDER_SENSITIVE}


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_same_result_any_shuffle_partitions(spark, baseline, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for n in ORDER_SENSITIVE:
            got = sorted(map(tuple, QUERIES[n](spark, SF001).collect()), key=repr)
            assert got == baseline[n], n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_histogram_single_value_and_edges(spark):
    df = spark.createDataFrame([(5,), (5,), (5,)], "demand long")
    h = {r["bin"]: r["count"] for r in X.histogram(spark, df, "demand", 10).collect()}
    assert h[1] == 3 and sum(h.values()) == 3
    df2 = spark.createDataFrame([(0,), (10,), (5,)], "demand long")
    h2 = {r["bin"]: r["count"] for r in X.histogram(spark, df2, "demand", 10).collect()}
    assert h2[1] == 1 and h2[6] == 1 and h2[10] == 1  # max lands in the last (closed) bin


def test_correlation_constant_is_null_and_mi(spark):
    df = spark.createDataFrame([(1, 3, 10), (1, 5, 20), (1, 3, 10), (1, 5, 20)], "month int, h int, demand long")
    c = {r["feature"]: r["abs_corr"] for r in X.abs_correlation_ranking(df, ["month", "h"]).collect()}
    assert c["month"] is None and abs(c["h"] - 1.0) < 1e-9
    mi = {r["feature"]: r["mutual_info"] for r in X.mutual_information_ranking(df, ["month", "h"]).collect()}
    assert abs(mi["month"]) < 1e-12 and abs(mi["h"] - 0.693147) < 1e-6  # ln 2


def test_lookup_as_of_and_zero_share(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 8), 8, 0, 4, 1.0, 1.0, 1.0, 1.0, 1.0), (1, dt.datetime(2024, 1, 8, 8), 8, 0, 0, 2.0, 2.0, 2.0, 2.0, 2.0)],
        "PULocationID int, hour timestamp_ntz, hour_of_day int, day_of_week int, demand long, demand_lag_1h double, "
        "demand_lag_24h double, demand_lag_168h double, demand_rolling_3h double, demand_rolling_168h double",
    )
    assert build_lookup(df).first()["mean_demand"] == 2.0
    assert build_lookup(df, as_of="2024-01-05").first()["mean_demand"] == 4.0
    z = X.zero_share(df).first()
    assert (z["zero_pct"], z["n_nonzero"], z["n_total"]) == (50.0, 1, 2)


def test_metric_delta_and_model_card(spark):
    long = spark.createDataFrame(
        [("a", "mae", 4.0), ("b", "mae", 3.0), ("a", "r2", 0.5), ("b", "r2", 0.6)], "model string, metric string, value double"
    )
    d = {r["metric"]: r for r in ME.metric_delta(long, "a", "b").collect()}
    assert d["mae"]["delta"] == -1.0 and d["mae"]["delta_pct"] == -25.0
    m = spark.createDataFrame([(3.62, 10.46, 0.9662, 42.7, -0.06)], "mae double, rmse double, r2 double, mape double, mbe double")
    card = {r["name"]: r for r in S.model_card(m, "v4", "Production").collect()}
    assert card["MAE"]["value"] == "3.62" and card["R²"]["value"] == "0.9662" and card["MAPE"]["value"] == "42.7%"
    assert "under-predicts" in card["MBE"]["interpretation"]


def test_heatmap_wide_and_compare(spark):
    rows = [(7, h, d, int(d >= 5), float(h + d)) for d in range(7) for h in range(24)]
    rows += [(9, h, 0, 0, 1.0) for h in range(24)]
    fc = spark.createDataFrame(rows, "zone_id int, hour_of_day int, day_of_week int, is_weekend int, prediction double")
    wide = S.heatmap_wide(S.heatmap(fc, 7)).orderBy("hour").collect()
    assert len(wide) == 24 and wide[3]["d2"] == 5.0
    cmp = {r["hour"]: r for r in S.compare(fc, {"zone": 7, "dow": 0, "weekend": 0}, {"zone": 9, "dow": 0, "weekend": 0}).collect()}
    assert len(cmp) == 24 and cmp[5]["difference"] == 4.0
