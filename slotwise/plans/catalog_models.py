"""Registered queries: metric suites and model jobs.

Seasonal-naive forecasts (J16) are plain columns, and linear fits come from moments
(``operators/moments.py``) that SQL can state too (``plans/linear_sql.py``), so their
metric suites are checked against DuckDB.  The forest has no SQL equivalent; its query
gets the driver's rows-only check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from slotwise.operators import models as M
from slotwise.operators import moments as MO
from slotwise.operators import splits as SP
from slotwise.operators.metrics import (
    FIVE,
    bias_direction,
    fold_summary,
    metric_delta,
    naive_predictions,
    regression_metrics,
    three_metrics,
    to_long,
)
from slotwise.plans import common as C
from slotwise.plans.evaluation import tune_and_retrain
from slotwise.plans.linear_sql import fit_ctes, forecast
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import FEATURE_COLS, TARGET
from slotwise.session import cut_lineage, ensure_checkpoint_dir

P = C.PROFILE
FEAT = C.PIPELINE_CTES
TEMPORAL = (
    f"CASE WHEN hour < TIMESTAMP '{P.val_start}' THEN 'train' "
    f"WHEN hour < TIMESTAMP '{P.test_start}' THEN 'val' ELSE 'test' END"
)
HASH_SQL = f"md5(concat_ws('|', CAST(PULocationID AS VARCHAR), CAST(hour AS VARCHAR), '{P.seed}'))"
NAIVE = {
    "lag_1h": "demand_lag_1h",
    "lag_24h": "demand_lag_24h",
    "lag_168h": "demand_lag_168h",
    "rolling_3h": "demand_rolling_3h",
    "rolling_168h": "demand_rolling_168h",
}


def _metric_sql(pred: str, y: str = "demand", rnd: str = "round({}, 6)") -> str:
    e = f"({pred} - {y})"
    parts = {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "r2": f"1.0 - sum({e} * {e}) / nullif(var_pop({y}) * count({y}), 0)",
        "mape": f"avg(CASE WHEN {y} > 0 THEN abs(({y} - {pred}) / {y}) END) * 100.0",
        "mbe": f"avg({e})",
    }
    return ", ".join(f"{rnd.format(v)} AS {k}" for k, v in parts.items())


def _labelled(spark, sf_dir):
    return SP.temporal_split(C.features(spark, sf_dir), P.val_start, P.test_start)


_naive_union = "\n  UNION ALL ".join(
    f"SELECT '{m}' AS model, split, demand, CAST({c} AS DOUBLE) AS prediction FROM labelled" for m, c in NAIVE.items()
)


@register(
    "naive_forecast_metrics",
    FEAT
    + f""", labelled AS (SELECT *, {TEMPORAL} AS split FROM features),
preds AS ({_naive_union})
SELECT model, split, {_metric_sql('prediction')}, count(*) AS n FROM preds GROUP BY 1, 2""",
)
def q_naive_forecast_metrics(spark, sf_dir):
    """J16 + J4: five-metric suite of seasonal-naive forecasts per split."""
    preds = naive_predictions(_labelled(spark, sf_dir), NAIVE, keep=["split"])
    return regression_metrics(preds, ["model", "split"], digits=6)


@register(
    "naive_forecast_metrics_long",
    FEAT
    + f""", labelled AS (SELECT *, {TEMPORAL} AS split FROM features),
preds AS ({_naive_union}),
wide AS (SELECT model, split, {_metric_sql('prediction')} FROM preds GROUP BY 1, 2)
UNPIVOT wide ON mae, rmse, r2, mape, mbe INTO NAME metric VALUE value""",
)
def q_naive_forecast_metrics_long(spark, sf_dir):
    """J4 long form ``(model, split, metric, value)``."""
    preds = naive_predictions(_labelled(spark, sf_dir), NAIVE, keep=["split"])
    return to_long(regression_metrics(preds, ["model", "split"], digits=6), ["model", "split"], FIVE)


_CV_NAIVE = {"lag_168h": "demand_lag_168h", "rolling_168h": "demand_rolling_168h"}
_cv_union = "\n  UNION ALL ".join(
    f"SELECT '{m}' AS model, test_fold AS fold, demand, CAST({c} AS DOUBLE) AS prediction FROM folded WHERE test_fold IS NOT NULL"
    for m, c in _CV_NAIVE.items()
)


@register(
    "naive_cv_summary",
    FEAT
    + f""", trainval AS (SELECT * FROM features WHERE hour < TIMESTAMP '{P.test_start}'),
folded AS (SELECT *, CASE WHEN pos >= first THEN CAST(floor((pos - first) / size) + 1 AS INTEGER) END AS test_fold FROM (
  SELECT *, row_number() OVER (ORDER BY hour, PULocationID) - 1 AS pos,
    count(*) OVER () - {P.folds} * (count(*) OVER () // {P.folds + 1}) AS first,
    count(*) OVER () // {P.folds + 1} AS size FROM trainval)),
preds AS ({_cv_union}),
per_fold AS (SELECT model, fold, {_metric_sql('prediction', rnd='round_even({}, 4)')} FROM preds GROUP BY 1, 2)
SELECT model, round(avg(mae), 4) AS mean_mae, round(stddev_samp(mae), 4) AS std_mae,
  round(avg(rmse), 4) AS mean_rmse, round(avg(r2), 4) AS mean_r2, count(*) AS folds FROM per_fold GROUP BY 1""",
)
def q_naive_cv_summary(spark, sf_dir):
    """J5 + J6 over I4: seasonal-naive forecasts scored on 5 expanding time
    folds of the train+val rows (fold metrics rounded half-even to 4)."""
    cols = ["PULocationID", "hour", TARGET, *_CV_NAIVE.values()]
    trainval = C.features_cut(spark, sf_dir, columns=cols).filter(F.col("hour") < F.lit(P.test_start).cast("timestamp_ntz"))
    folded = SP.time_series_blocks(trainval, P.folds).filter(F.col("test_fold").isNotNull())
    preds = naive_predictions(folded.withColumnRenamed("test_fold", "fold"), _CV_NAIVE, keep=["fold"])
    per_fold = three_metrics(preds, ["model", "fold"])
    return fold_summary(per_fold)


@register(
    "bias_direction",
    FEAT
    + f""", labelled AS (SELECT *, {TEMPORAL} AS split FROM features),
preds AS ({_naive_union})
SELECT model, round(avg(prediction - demand), 6) AS mbe,
  CASE WHEN round(avg(prediction - demand), 6) > 0 THEN 'over-predicts: risk of overstaffing'
       ELSE 'under-predicts: risk of understaffing' END AS direction
FROM preds WHERE split = 'val' GROUP BY 1""",
)
def q_bias_direction(spark, sf_dir):
    """over/under-prediction of each naive forecast on validation."""
    preds = naive_predictions(_labelled(spark, sf_dir), NAIVE, keep=["split"]).filter(F.col("split") == "val")
    m = regression_metrics(preds, ["model"], metrics=["mbe"], digits=6).select("model", "mbe")
    return m.select("model", "mbe", bias_direction("mbe").alias("direction"))


PENALTIES = {"linear_regression": 0.0, "ridge": 1.0}
_TRAIN = f"""labelled AS MATERIALIZED (SELECT *, {TEMPORAL} AS split FROM features),
train AS (SELECT * FROM labelled WHERE split = 'train')"""
_LINEAR = f""", {_TRAIN},
{fit_ctes("ols", "train")},
{fit_ctes("ridge", "train", alpha=1.0)},
preds AS (SELECT 'linear_regression' AS model, demand, {forecast("ols")} AS prediction FROM labelled, ols WHERE split = 'val'
  UNION ALL SELECT 'ridge', demand, {forecast("ridge")} FROM labelled, ridge WHERE split = 'val')"""


@register("linear_model_metrics", FEAT + _LINEAR + f"\nSELECT model, {_metric_sql('prediction')}, count(*) AS n FROM preds GROUP BY 1")
def q_linear_model_metrics(spark, sf_dir):
    """J1 + J2 + J12: OLS and ridge from the moments of the train rows, scored on validation."""
    return round_doubles(MO.compare_linear(_labelled(spark, sf_dir), PENALTIES))


@register(
    "feature_moments",
    FEAT
    + f""", labelled AS (SELECT *, {TEMPORAL} AS split FROM features),
m AS (SELECT split, [{", ".join(f"CAST({c} AS DOUBLE)" for c in [*FEATURE_COLS, TARGET])}] AS x FROM labelled),
l AS (SELECT split, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sum(CASE WHEN j = 0 THEN x[i] ELSE x[i] * x[j] END) AS v
  FROM m, range(1, {len(FEATURE_COLS) + 2}) a(i), range(0, {len(FEATURE_COLS) + 2}) b(j) WHERE j = 0 OR j >= i GROUP BY ALL)
SELECT split, i, j, CAST(printf('%.9e', v) AS DOUBLE) AS value FROM l""",
)
def q_feature_moments(spark, sf_dir):
    """Sums (j = 0) and products of the features and the label per split, to 10 significant digits."""
    table = MO.moment_table(_labelled(spark, sf_dir), ["split"])
    size = len(FEATURE_COLS) + 1
    cells = [F.struct(F.lit(i + 1).alias("i"), F.lit(0).alias("j"), F.col(f"s_{i}").alias("v")) for i in range(size)]
    cells += [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), F.col(f"p_{i}_{j}").alias("v")) for i in range(size) for j in range(i, size)]
    long = table.select("split", F.explode(F.array(*cells)).alias("c")).select("split", "c.i", "c.j", "c.v")
    return long.select("split", "i", "j", F.format_string("%.9e", "v").cast("double").alias("value"))


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """OLS, baseline forest (100 trees, seed 42) and ridge on the
    temporal split, same metric names."""
    models = {
        "linear_regression": M.linear_regression(),
        "random_forest": M.random_forest(),
        "ridge": M.ridge(1.0),
    }
    return M.compare_models(_labelled(spark, sf_dir), models)


@register(
    "ridge_vs_ols_delta",
    FEAT
    + _LINEAR
    + f""",
wide AS (SELECT model, {_metric_sql('prediction', rnd='{}')} FROM preds GROUP BY 1),
long AS (UNPIVOT wide ON mae, rmse, r2, mape, mbe INTO NAME metric VALUE value)
SELECT a.metric, round(a.value, 6) AS baseline, round(b.value, 6) AS candidate, round(b.value - a.value, 6) + 0.0 AS delta,
  round((b.value - a.value) * 100.0 / nullif(abs(a.value), 0), 6) + 0.0 AS delta_pct
FROM long a JOIN long b ON a.metric = b.metric AND a.model = 'linear_regression' AND b.model = 'ridge'""",
)
def q_ridge_vs_ols_delta(spark, sf_dir):
    """Change of every validation metric from OLS to ridge, both from the same moments."""
    wide = MO.compare_linear(_labelled(spark, sf_dir), PENALTIES)
    return round_doubles(metric_delta(to_long(wide, ["model"]), "linear_regression", "ridge"))


def _trainval(spark, sf_dir):
    return C.features(spark, sf_dir).filter(F.col("hour") < F.lit(P.test_start).cast("timestamp_ntz"))


_TRAINVAL = f"trainval AS MATERIALIZED (SELECT * FROM features WHERE hour < TIMESTAMP '{P.test_start}')"
_FOLDED = f"""folded AS MATERIALIZED (SELECT *, CASE WHEN pos >= first THEN CAST(floor((pos - first) / size) + 1 AS INTEGER) END AS test_fold FROM (
  SELECT *, row_number() OVER (ORDER BY hour, PULocationID) - 1 AS pos,
    count(*) OVER () - {P.folds} * (count(*) OVER () // {P.folds + 1}) AS first,
    count(*) OVER () // {P.folds + 1} AS size FROM trainval)),
before AS (SELECT f, folded.* FROM folded JOIN range(1, {P.folds + 1}) t(f) ON pos < first + (f - 1) * size),
{fit_ctes("ts", "before", "f")},
ts_preds AS (SELECT test_fold AS fold, demand, {forecast("ts")} AS prediction FROM folded JOIN ts ON ts.grp = test_fold),
ts_folds AS (SELECT fold, {_metric_sql('prediction', rnd='round_even({}, 4)')} FROM ts_preds GROUP BY 1)"""
_SHUFFLED = f"""mixed AS MATERIALIZED (SELECT *, CAST(CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1)) ELSE r + floor((pos - r * (q + 1)) / q) END AS INTEGER) AS fold FROM (
  SELECT *, row_number() OVER (ORDER BY {HASH_SQL}) - 1 AS pos, count(*) OVER () // {P.folds} AS q, count(*) OVER () % {P.folds} AS r FROM trainval)),
others AS (SELECT f, mixed.* FROM mixed JOIN range(0, {P.folds}) t(f) ON fold <> f),
{fit_ctes("sh", "others", "f")},
sh_preds AS (SELECT fold, demand, {forecast("sh")} AS prediction FROM mixed JOIN sh ON sh.grp = fold),
sh_folds AS (SELECT fold, {_metric_sql('prediction', rnd='round({}, 4)')}, count(*) AS n FROM sh_preds GROUP BY 1)"""


@register("linear_time_series_cv", FEAT + f", {_TRAINVAL},\n{_FOLDED}\nSELECT 'linear_regression' AS model, fold, mae, rmse, r2 FROM ts_folds")
def q_linear_time_series_cv(spark, sf_dir):
    """OLS on 5 expanding time folds of train+val from one scan of moments; per-fold MAE/RMSE/R^2."""
    folds = cut_lineage(SP.time_series_blocks(_trainval(spark, sf_dir), P.folds).select(*FEATURE_COLS, TARGET, "test_fold"))
    return MO.time_series_cv(folds, 0.0, "linear_regression")


@register("linear_shuffled_cv", FEAT + f", {_TRAINVAL},\n{_SHUFFLED}\nSELECT 'linear_regression' AS model, fold, mae, rmse, r2, n FROM sh_folds")
def q_linear_shuffled_cv(spark, sf_dir):
    """OLS on 5 shuffled folds of train+val from one scan of moments; per-fold MAE/RMSE/R^2."""
    folds = cut_lineage(SP.shuffled_folds(_trainval(spark, sf_dir), P.folds, P.seed).select(*FEATURE_COLS, TARGET, "fold"))
    return MO.shuffled_cv(folds, 0.0, "linear_regression")


_WINDOW = (
    f"CASE WHEN hour < TIMESTAMP '{P.alt_val_start}' THEN 'train' WHEN hour < TIMESTAMP '{P.alt_val_end}' THEN 'val' ELSE 'unused' END"
)


@register(
    "split_method_comparison",
    FEAT
    + f""", {_TRAINVAL},
{_FOLDED},
{_SHUFFLED},
{_TRAIN},
{fit_ctes("ols", "train")},
windowed AS MATERIALIZED (SELECT *, {_WINDOW} AS part FROM features),
wtrain AS (SELECT * FROM windowed WHERE part = 'train'),
{fit_ctes("alt", "wtrain")},
held AS (SELECT 'temporal_holdout' AS method, demand, {forecast("ols")} AS prediction FROM labelled, ols WHERE split = 'val'
  UNION ALL SELECT 'temporal_window', demand, {forecast("alt")} FROM windowed, alt WHERE part = 'val')
SELECT 'temporal_cv' AS method, round(avg(mae), 4) AS mae, round(stddev_samp(mae), 4) AS mae_std, round(avg(rmse), 4) AS rmse, round(avg(r2), 4) AS r2 FROM ts_folds
UNION ALL SELECT 'shuffled_cv', round(avg(mae), 4), round(stddev_samp(mae), 4), round(avg(rmse), 4), round(avg(r2), 4) FROM sh_folds
UNION ALL SELECT method, mae, NULL, rmse, r2 FROM (SELECT method, {_metric_sql('prediction', rnd='round({}, 4)')} FROM held GROUP BY 1)""",
)
def q_split_method_comparison(spark, sf_dir):
    """Temporal CV, the two temporal hold-outs and shuffled CV of OLS, all from one scan of moments."""
    data = C.features_cut(spark, sf_dir, columns=[*dict.fromkeys([*FEATURE_COLS, "hour", TARGET])])
    inside = data.filter(F.col("hour") < F.lit(P.test_start).cast("timestamp_ntz"))
    mixed = SP.shuffled_folds(inside, P.folds, P.seed)
    blocks = SP.block_label(inside, P.folds)
    labels = mixed.select(*data.columns, F.lit(True).alias("in_cv"), blocks.alias("test_fold"), "fold")
    after = data.filter(F.col("hour") >= F.lit(P.test_start).cast("timestamp_ntz")).select(
        *data.columns, F.lit(False).alias("in_cv"), F.lit(None).cast("int").alias("test_fold"), F.lit(None).cast("int").alias("fold")
    )
    both = SP.temporal_split(labels.unionByName(after), P.val_start, P.test_start).withColumnRenamed("split", "holdout")
    both = SP.window_split(both, P.alt_val_start, P.alt_val_end).withColumnRenamed("split", "window")
    tagged = cut_lineage(both.drop("hour"))
    return MO.split_comparison(tagged, {"temporal_holdout": "holdout", "temporal_window": "window"})


_RANDOM = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {HASH_SQL}, PULocationID, hour) - 1 AS pos, count(*) OVER () AS n FROM features),
labelled AS MATERIALIZED (SELECT *, CASE WHEN pos < ceil(n * 0.2) THEN 'test' WHEN pos < ceil(n * 0.2) + ceil((n - ceil(n * 0.2)) * 0.25) THEN 'val' ELSE 'train' END AS split FROM ranked),
first_part AS (SELECT * FROM labelled WHERE split = 'train'),
both_parts AS (SELECT * FROM labelled WHERE split <> 'test')"""


@register(
    "linear_honest_retrain",
    FEAT
    + f""", {_RANDOM},
{fit_ctes("one", "first_part")},
{fit_ctes("two", "both_parts")},
preds AS (SELECT split, demand, {forecast("one")} AS prediction FROM labelled, one WHERE split = 'val'
  UNION ALL SELECT split, demand, {forecast("two")} FROM labelled, two WHERE split = 'test')
SELECT split, {_metric_sql('prediction')}, count(*) AS n FROM preds GROUP BY 1""",
)
def q_linear_honest_retrain(spark, sf_dir):
    """J10 with OLS on the random 60/20/20 split: train -> val, train + val -> test, from one scan of moments."""
    columns = [*dict.fromkeys([*FEATURE_COLS, "hour", TARGET])]
    labelled = SP.random_split(C.features_cut(spark, sf_dir, columns=columns), P.seed)
    metrics, _ = MO.honest_retrain(cut_lineage(labelled.select(*FEATURE_COLS, TARGET, "split")))
    return round_doubles(metrics)


#: The small space that ``forest_search`` names.
SMALL = {"n_trials": 3, "max_bins": 32, "space": {"trees": (5, 15, 5), "depth": (3, 6), "leaf": (1, 20)}}


def _search(spark, sf_dir, time_folds: bool, **limits):
    columns = [*dict.fromkeys([*FEATURE_COLS, "hour", TARGET])]
    log = f"{ensure_checkpoint_dir(spark)}/trials-{uuid.uuid4().hex}"
    return tune_and_retrain(C.features_cut(spark, sf_dir, columns=columns), P, **limits, time_folds=time_folds, log=log)


@register("forest_search")
def q_forest_search(spark, sf_dir):
    """Three forests drawn from a small space, shuffled folds of the train rows, best first."""
    return round_doubles(_search(spark, sf_dir, False, **SMALL)[0])


@register("forest_search_retrained")
def q_forest_search_retrained(spark, sf_dir):
    """J9 over expanding folds, 15 trials of 100 to 500 trees to depth 5 to 30, then J10: the best forest scored on val and, fitted on train + val, on test."""
    return round_doubles(_search(spark, sf_dir, True)[1])
