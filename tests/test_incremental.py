"""Growing tables: fill means from cells, appended dates, stored column decisions, resumed searches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slotwise.operators import models as M
from slotwise.operators import panel as PN
from slotwise.operators import splits as SP
from slotwise.operators.features import build_features
from slotwise.operators.quality import drop_sparse_by_decision
from slotwise.plans import common as C
from slotwise.plans.feature_build import append_dates, build_base
from slotwise.session import configure
from slotwise.sources.io import read_feature_table
from tests.conftest import SF001, SF01, rows

P = C.PROFILE


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("until", [None, "2024-01-03", "2023-12-01"])
def test_fill_from_cells_equals_the_window(spark, until):
    configure(spark)
    trips = C.clean(spark, SF01)
    plain = build_features(PN.build_panel(trips, 36, holidays=P.holidays), fill_until=until)
    quick = build_features(PN.build_panel(trips, 36, holidays=P.holidays, with_fill=True, fill_until=until))
    assert plain.columns == quick.columns and _same(plain, quick)


def test_fill_of_a_calendar_shorter_than_a_day(spark):
    start = dt.datetime(2025, 1, 6, 22)
    trips = spark.createDataFrame(
        [(z, start + dt.timedelta(hours=h)) for z, h in [(1, 0), (1, 0), (1, 4), (2, 2)]], "PULocationID int, tpep_pickup_datetime timestamp_ntz"
    )
    assert _same(build_features(PN.build_panel(trips, 1)), build_features(PN.build_panel(trips, 1, with_fill=True)))


def test_feature_table_sorts_the_panel_once(spark):
    configure(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a cell table too large to broadcast
    try:
        plan = C.features(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sorts = [ln for ln in plan.splitlines() if " Sort [" in ln or "+- Sort [" in ln]
    # the two sides of the grid join; lags and rolling sums reuse the order of its left side
    assert len(sorts) == 2, plan


def test_appended_dates_equal_one_build(spark, tmp_path):
    configure(spark)
    trips = C.trips(spark, SF001)
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    build_base(trips, grown, P, "2024-01-05", 1)
    for day in range(5, 16):
        append_dates(trips, grown, P, f"2024-01-{day:02d}", f"2024-01-{day:02d}")
    build_base(trips, whole, P, "2024-01-05", 1)
    append_dates(trips, whole, P, "2024-01-05", "2024-01-15")
    assert _same(read_feature_table(spark, grown), read_feature_table(spark, whole))
    # a repeated run replaces its date with the same rows
    before = rows(read_feature_table(spark, grown), "PULocationID", "hour")
    append_dates(trips, grown, P, "2024-01-15", "2024-01-15")
    assert rows(read_feature_table(spark, grown), "PULocationID", "hour") == before
    for first, last in [("2024-01-17", "2024-01-17"), ("2024-01-10", "2024-01-12")]:  # a gap; later dates would grow stale
        with pytest.raises(ValueError):
            append_dates(trips, grown, P, first, last)


def test_appended_date_without_trips_is_zero(spark, tmp_path):
    configure(spark)
    trips = C.trips(spark, SF001)
    path = str(tmp_path / "t")
    build_base(trips, path, P, "2024-01-05", 1)
    append_dates(trips.filter("false"), path, P, "2024-01-05", "2024-01-05")
    day = read_feature_table(spark, path).filter("date = DATE'2024-01-05'")
    zones = spark.read.parquet(path + "_zones").count()
    assert day.count() == zones * 24 and day.agg(F.sum("demand")).first()[0] == 0


def test_column_decision_is_kept(spark, tmp_path):
    where = str(tmp_path / "decision")
    first = spark.createDataFrame([(1, None, 1), (2, None, None)], "a int, b int, c int")
    later = spark.createDataFrame([(None, 5, 7, "x")], "a int, b int, c int, d string")
    assert drop_sparse_by_decision(first, where, 60.0).columns == ["a", "c"]
    kept = drop_sparse_by_decision(later, where, 60.0)  # b is whole and a is missing here, yet the decision stands
    assert kept.columns == ["a", "c", "d"] and rows(kept) == [(None, 7, "x")]
    with pytest.raises(ValueError):
        drop_sparse_by_decision(later.select("b"), where, 60.0)


@pytest.mark.parametrize("time_folds", [False, True])
def test_search_goes_on_from_its_log(spark, tmp_path, time_folds):
    feats = SP.random_split(C.features(spark, SF001).limit(1500)).cache()
    tr, va = feats.filter("split = 'train'"), feats.filter("split = 'val'")
    folds = SP.time_series_folds(tr, 2) if time_folds else SP.shuffled_folds(tr, 2)
    trials = M.draw_trials(3, seed=7, trees=(2, 4, 2), depth=(2, 3), leaf=(1, 3))
    log = str(tmp_path / "log")
    whole = M.random_search(folds, tr, va, trials, k=2, max_bins=16)
    M.random_search(folds, tr, va, trials[:2], k=2, max_bins=16, log=log)  # the driver is lost after two trials
    again = M.random_search(folds, tr, va, trials, k=2, max_bins=16, log=log)
    assert rows(again) == rows(whole)
    with pytest.raises(ValueError):
        M.random_search(folds, tr, va, M.draw_trials(3, seed=8, trees=(2, 4, 2), depth=(2, 3), leaf=(4, 9)), k=2, log=log)
