"""Linear fits from mergeable moments.

A least-squares fit needs nothing of its rows but their count, the sums of every
column and the sums of every product of two columns.  These add up: the moments of
two sets of rows are the sum of the moments of each.  So one scan, grouped by the
labels of the rows (split, time block, hash fold), carries every fit over them:

* expanding time folds train on the blocks before theirs: prefix sums of the blocks;
* shuffled folds train on all but their own: the total minus the fold;
* hold-outs train on the labels they name: a sum of those.

The scan is one partially aggregated ``groupBy`` whose result has one row per label
combination, whatever the number of rows.  Only these rows reach the driver, which
solves systems of the size of the feature list.  A second scan scores all fits at
once: predictions are map-only expressions, the metrics one grouped aggregate.

Degenerate columns.  A feature that does not vary in the training rows, or that the
features before it determine, gets the coefficient 0; predictions then equal those of
any other least-squares solution.  A row whose label or any feature is null or NaN
takes no part in a fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.metrics import regression_metrics
from slotwise.schemas import FEATURE_COLS, TARGET

#: Share of a column's variation below which what the columns before it leave over counts as none.
TOLERANCE = 1e-9
#: Share of the sum of squares below which a centred sum of squares counts as none.
CONSTANT = 1e-12


@dataclass(frozen=True)
class Moments:
    """Count, sums and cross-product sums of ``columns`` (the label last)."""

    columns: tuple[str, ...]
    count: int
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        self._same(other)
        return Moments(self.columns, self.count + other.count, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        self._same(other)
        return Moments(self.columns, self.count - other.count, self.sums - other.sums, self.products - other.products)

    def _same(self, other: Moments) -> None:
        if self.columns != other.columns:
            raise ValueError("moments of different columns cannot be combined")

    def centred(self) -> np.ndarray:
        """Sums of products of deviations from the means; 0 where a column does not vary."""
        out = self.products - np.outer(self.sums, self.sums) / max(self.count, 1)
        flat = np.diag(out) <= CONSTANT * np.diag(self.products)
        out[flat, :] = 0.0
        out[:, flat] = 0.0
        return out

    def fit(self, alpha: float = 0.0) -> LinearFit:
        """Least squares with the penalty ``alpha * |w|^2``; the intercept is free of it.

        The normal equations are scaled to a unit diagonal and eliminated feature by
        feature; a pivot below TOLERANCE has nothing left to explain and is skipped.
        """
        features = len(self.columns) - 1
        if self.count <= 0:
            raise ValueError("no rows to fit")
        spread = self.centred()
        gram, with_label = spread[:features, :features] + alpha * np.eye(features), spread[:features, features]
        scale = np.sqrt(np.diag(gram))
        safe = np.where(scale > 0, scale, 1.0)
        rows = np.column_stack([gram / np.outer(safe, safe), with_label / safe])
        used = []
        for k in range(features):
            if rows[k, k] <= TOLERANCE:
                continue
            used.append(k)
            rows[k] /= rows[k, k]
            others = np.arange(features) != k
            rows[others] -= np.outer(rows[others, k], rows[k])
        weights = np.zeros(features)
        weights[used] = rows[used, features] / safe[used]
        means = self.sums / self.count
        return LinearFit(self.columns[:features], float(means[features] - weights @ means[:features]), tuple(float(w) for w in weights))


@dataclass(frozen=True)
class LinearFit:
    """A linear forecast as plain numbers."""

    features: tuple[str, ...]
    intercept: float
    weights: tuple[float, ...]

    def column(self) -> Column:
        """The forecast as a column expression (runs inside code generation)."""
        out = F.lit(self.intercept)
        for name, weight in zip(self.features, self.weights):
            out = out + F.lit(weight) * F.col(f"`{name}`").cast("double")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, map-only (stands in for a fitted pipeline when serving)."""
        return df.select("*", self.column().alias("prediction"))


def moment_table(df: DataFrame, by: Sequence[str] = (), features: Sequence[str] = FEATURE_COLS, label: str = TARGET) -> DataFrame:
    """One row per group: ``by``, ``n``, ``s_i`` and ``p_i_j`` (i <= j), columns numbered in order, the label last."""
    columns = [*features, label]
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    present = None
    for c in x:
        one = c.isNotNull() & ~F.isnan(c)
        present = one if present is None else present & one
    whole = df.filter(present)
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def collect_moments(
    df: DataFrame, by: Sequence[str] = (), features: Sequence[str] = FEATURE_COLS, label: str = TARGET, most: int = 10_000
) -> dict[tuple, Moments]:
    """Moments per combination of the ``by`` labels; more than ``most`` combinations are refused."""
    columns = (*features, label)
    size = len(columns)
    rows = moment_table(df, by, features, label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} label combinations; labels must be few")
    out = {}
    for r in rows:
        if not r["n"]:
            continue
        products = np.empty((size, size))
        for i in range(size):
            for j in range(i, size):
                products[i, j] = products[j, i] = r[f"p_{i}_{j}"]
        out[tuple(r[c] for c in by)] = Moments(columns, r["n"], np.array([r[f"s_{i}"] for i in range(size)], float), products)
    return out


def total(parts: Iterable[Moments]) -> Moments:
    """The moments of all rows of the parts."""
    found = list(parts)
    if not found:
        raise ValueError("no rows to fit")
    out = found[0]
    for m in found[1:]:
        out = out + m
    return out


def expanding(blocks: Mapping[int | None, Moments]) -> dict[int, Moments]:
    """Training moments of expanding folds: everything before block f (None is before the first)."""
    out = {}
    for fold in sorted(k for k in blocks if k is not None):
        out[fold] = total(m for k, m in blocks.items() if k is None or k < fold)
    return out


def leave_one_out(folds: Mapping[int, Moments]) -> dict[int, Moments]:
    """Training moments of shuffled folds: the total minus each fold."""
    whole = total(folds.values())
    return {k: whole - m for k, m in folds.items()}


def score(
    df: DataFrame, fits: Mapping[tuple, LinearFit], on: Sequence[str], names: Sequence[str], label: str = TARGET, keep: Sequence[str] = ()
) -> DataFrame:
    """(names, keep, label, prediction): every row under every fit whose ``on`` labels it carries.

    ``fits`` maps (*names, *labels) to a fit.  The fits are listed per label
    combination inside one expression, so scoring is map-only and reads a row once
    however many models share its label.
    """
    groups: dict[tuple, list[tuple[tuple, LinearFit]]] = {}
    for key, fit in fits.items():
        groups.setdefault(key[len(names) :], []).append((key[: len(names)], fit))
    chosen = None
    for labels, members in groups.items():
        entries = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, key)], fit.column().alias("prediction")) for key, fit in members])
        here = F.lit(True)
        for name, value in zip(on, labels):
            here = here & F.col(f"`{name}`").eqNullSafe(F.lit(value))
        chosen = F.when(here, entries) if chosen is None else chosen.when(here, entries)
    out = df.select(*keep, F.col(f"`{label}`"), F.explode(chosen).alias("__s"))
    return out.select(*[F.col(f"__s.{n}").alias(n) for n in names], *keep, F.col(f"`{label}`"), F.col("__s.prediction").alias("prediction"))


def compare_linear(
    labelled: DataFrame, penalties: Mapping[str, float], train_split: str = "train", eval_split: str = "val", features: Sequence[str] = FEATURE_COLS
) -> DataFrame:
    """One model per penalty from the same moments, scored on another split (five metrics)."""
    moments = collect_moments(labelled.filter(F.col("split") == train_split), ["split"], features)
    fits = {(name, eval_split): moments[(train_split,)].fit(alpha) for name, alpha in penalties.items()}
    held = labelled.filter(F.col("split") == eval_split)
    return regression_metrics(score(held, fits, ["split"], ["model"]), ["model"])


def fold_scores(folded: DataFrame, fold: str, train: Mapping[int, Moments], alpha: float = 0.0) -> DataFrame:
    """(fold, label, prediction) of every row in a test fold under the fit of its fold."""
    fits = {(k, k): m.fit(alpha) for k, m in train.items()}
    return score(folded.filter(F.col(fold).isNotNull()), fits, [fold], ["fold"])


def time_series_cv(folds: DataFrame, alpha: float = 0.0, model_name: str = "model", features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """J7 over a frame labelled by ``time_series_folds``: MAE, RMSE and R^2 per fold, half-even to 4 places."""
    from slotwise.operators.metrics import three_metrics

    blocks = {k[0]: m for k, m in collect_moments(folds, ["test_fold"], features).items()}
    preds = fold_scores(folds, "test_fold", expanding(blocks), alpha)
    return three_metrics(preds, ["fold"]).select(F.lit(model_name).alias("model"), "*")


def shuffled_cv(folds: DataFrame, alpha: float = 0.0, model_name: str = "model", features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """J8 over a frame labelled by ``shuffled_folds``: MAE, RMSE and R^2 per fold, rounded to 4 places."""
    parts = {k[0]: m for k, m in collect_moments(folds, ["fold"], features).items()}
    preds = fold_scores(folds, "fold", leave_one_out(parts), alpha)
    return regression_metrics(preds, ["fold"], metrics=["mae", "rmse", "r2"], digits=4).select(F.lit(model_name).alias("model"), "*")


def train_fit(labelled: DataFrame, alpha: float = 0.0, split: str = "train", features: Sequence[str] = FEATURE_COLS) -> LinearFit:
    """The fit on one split of a labelled table."""
    return total(collect_moments(labelled.filter(F.col("split") == split), ["split"], features).values()).fit(alpha)


def honest_retrain(labelled: DataFrame, alpha: float = 0.0, features: Sequence[str] = FEATURE_COLS) -> tuple[DataFrame, LinearFit]:
    """J10 from one scan of moments: fit train -> score val; fit train + val -> score test; fit all.

    Returns (split, five metrics, n) of the two scored stages and the fit on every row.
    """
    parts = {k[0]: m for k, m in collect_moments(labelled, ["split"], features).items()}
    grown = total([parts["train"], parts["val"]])
    fits = {("val", "val"): parts["train"].fit(alpha), ("test", "test"): grown.fit(alpha)}
    held = labelled.filter(F.col("split").isin("val", "test"))
    metrics = regression_metrics(score(held, fits, ["split"], ["stage"]), ["stage"]).withColumnRenamed("stage", "split")
    return metrics, total([grown, parts["test"]]).fit(alpha)


def split_comparison(tagged: DataFrame, holdouts: Mapping[str, str], alpha: float = 0.0, features: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """(method, mae, mae_std, rmse, r2) of temporal CV, hold-outs and shuffled CV.

    ``tagged`` carries ``test_fold`` and ``fold`` (the label columns of the two CVs, null
    outside of them), ``in_cv``, and one split column per hold-out (``holdouts``: method ->
    column).  One scan groups the moments by all labels; every training set is a sum of
    groups.  One more scan scores every row under each fit that tests it.
    """
    from slotwise.operators.metrics import THREE, fold_summary, metric_columns

    labels = ["in_cv", "test_fold", "fold", *holdouts.values()]
    cells = collect_moments(tagged, labels, features)

    def regrouped(label: str, where=lambda key: True) -> dict:
        at, groups = labels.index(label), {}
        for key, m in cells.items():
            if where(key):
                groups.setdefault(key[at], []).append(m)
        return {k: total(v) for k, v in groups.items()}

    in_cv = lambda key: key[0]
    fits = {}
    for k, m in expanding(regrouped("test_fold", in_cv)).items():
        fits["temporal_cv", k] = ("test_fold", k, m.fit(alpha))
    for k, m in leave_one_out(regrouped("fold", in_cv)).items():
        fits["shuffled_cv", k] = ("fold", k, m.fit(alpha))
    for method, column in holdouts.items():
        fits[method, -1] = (column, "val", regrouped(column)["train"].fit(alpha))
    entries = [
        F.when(
            F.col(column).eqNullSafe(F.lit(value)) & (F.col("in_cv") if part >= 0 else F.lit(True)),
            F.struct(F.lit(method).alias("method"), F.lit(part).alias("part"), fit.column().alias("prediction")),
        )
        for (method, part), (column, value, fit) in fits.items()
    ]
    scored = tagged.select(TARGET, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("s")).select(
        F.col("s.method").alias("method"), F.col("s.part").alias("part"), TARGET, F.col("s.prediction").alias("prediction")
    )
    cols = metric_columns()
    # folds are rounded before they are averaged: half-even in time order, half-up when shuffled and for hold-outs
    per_part = scored.groupBy("method", "part").agg(*[cols[m].alias(m) for m in THREE])
    even = F.col("method") == "temporal_cv"
    per_part = per_part.select("method", "part", *[F.when(even, F.bround(m, 4)).otherwise(F.round(m, 4)).alias(m) for m in THREE])
    summary = fold_summary(per_part, ["method"])
    single = F.col("folds") == 1
    return summary.select(
        "method", F.col("mean_mae").alias("mae"), F.when(~single, F.col("std_mae")).alias("mae_std"), F.col("mean_rmse").alias("rmse"), F.col("mean_r2").alias("r2")
    )
