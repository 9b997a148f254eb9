"""Linear fits from moments: against pyspark.ml, numpy and one fit per fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import models as M
from slotwise.operators import moments as MO
from slotwise.operators import splits as SP
from slotwise.plans import common as C
from slotwise.schemas import FEATURE_COLS, TARGET

SF001 = "/root/testdata/sf0.001"
P = C.PROFILE


@pytest.fixture(scope="module")
def feats(spark):
    return C.features(spark, SF001).cache()


@pytest.fixture(scope="module")
def labelled(feats):
    return SP.temporal_split(feats, P.val_start, P.test_start).cache()


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_fit_equals_the_distributed_solver(labelled, alpha):
    train = labelled.filter("split = 'train'")
    model = M.fit(M.ridge(alpha) if alpha else M.linear_regression(), train).stages[-1]
    fit = MO.train_fit(labelled, alpha)
    assert np.allclose(fit.weights, model.coefficients.toArray(), rtol=1e-9, atol=1e-9)
    assert abs(fit.intercept - model.intercept) < 1e-9


def test_fit_equals_closed_form(labelled):
    rows = labelled.filter("split = 'train'").select(*FEATURE_COLS, TARGET).toPandas().astype(float).to_numpy()
    x, y = rows[:, :-1], rows[:, -1]
    for alpha in (0.0, 3.0):
        c = x - x.mean(axis=0)
        w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean()))
        assert np.allclose(MO.train_fit(labelled, alpha).weights, w, rtol=1e-7, atol=1e-9)


def test_moments_add_up(labelled):
    parts = MO.collect_moments(labelled, ["split"])
    whole = MO.collect_moments(labelled)[()]
    summed = MO.total(parts.values())
    assert summed.count == whole.count and np.allclose(summed.products, whole.products, rtol=1e-12)
    rest = whole - parts[("val",)]
    assert rest.count == whole.count - parts[("val",)].count
    assert np.allclose(rest.products, (parts[("train",)] + parts[("test",)]).products, rtol=1e-9, atol=1e-6)
    with pytest.raises(ValueError):
        whole + MO.collect_moments(labelled, (), ["hour_of_day"])[()]


def test_cross_validation_equals_one_fit_per_fold(feats):
    inside = feats.filter(F.col("hour") < F.lit(P.test_start).cast("timestamp_ntz"))
    timed = SP.time_series_folds(inside, P.folds).cache()
    got = {r["fold"]: r for r in MO.time_series_cv(timed).collect()}
    starts = {r[0]: r[1] for r in timed.filter("test_fold is not null").groupBy("test_fold").agg(F.min("fold_start")).collect()}
    for f in (1, 3, 5):
        rows = timed.filter(F.col("pos") < starts[f]).select(*FEATURE_COLS, TARGET).toPandas().astype(float).to_numpy()
        test = timed.filter(F.col("test_fold") == f).select(*FEATURE_COLS, TARGET).toPandas().astype(float).to_numpy()
        design = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
        w = np.linalg.lstsq(design, rows[:, -1], rcond=None)[0]
        err = np.column_stack([np.ones(len(test)), test[:, :-1]]) @ w - test[:, -1]
        assert abs(got[f]["mae"] - np.abs(err).mean()) < 1e-3 and abs(got[f]["rmse"] - np.sqrt((err**2).mean())) < 1e-3
    mixed = SP.shuffled_folds(inside, P.folds, P.seed).cache()
    old = {r["fold"]: r["mae"] for r in M.shuffled_cv(mixed, M.linear_regression(), P.folds).collect()}
    assert {r["fold"]: r["mae"] for r in MO.shuffled_cv(mixed).collect()} == pytest.approx(old, abs=2e-4)


def test_constant_repeated_and_missing_values(spark):
    rows = [(float(i), 2.0 * i, 7.0, 3.0 * i + 1.0) for i in range(20)] + [(None, 1.0, 1.0, 99.0), (1.0, float("nan"), 1.0, 99.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, demand double")
    fit = MO.collect_moments(df, (), ["a", "b", "c"])[()].fit()
    assert fit.weights[1:] == (0.0, 0.0) and fit.weights[0] == pytest.approx(3.0) and fit.intercept == pytest.approx(1.0)
    assert [round(r["prediction"], 9) for r in fit.transform(df.limit(3)).collect()] == [1.0, 4.0, 7.0]
    assert MO.collect_moments(df.limit(0), ["c"], ["a", "b"]) == {}
    with pytest.raises(ValueError):
        MO.total([])


def test_one_feature_is_the_slope(labelled):
    fit = MO.total(MO.collect_moments(labelled, ["split"], ["demand_lag_24h"]).values()).fit()
    r = labelled.agg(F.covar_pop("demand_lag_24h", TARGET), F.var_pop("demand_lag_24h"), F.avg(TARGET), F.avg("demand_lag_24h")).first()
    assert fit.weights[0] == pytest.approx(r[0] / r[1], rel=1e-9)
    assert fit.intercept == pytest.approx(r[2] - r[0] / r[1] * r[3], rel=1e-9)


def test_labels_must_be_few(labelled):
    with pytest.raises(ValueError):
        MO.collect_moments(labelled, ["hour"], ["hour_of_day"], most=10)
