"""Registered queries: positions, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators import splits as SP
from slotwise.operators.explore import zero_share
from slotwise.plans import common as C
from slotwise.plans.registry import register, round_doubles
from slotwise.schemas import HOUR, ZONE

P = C.PROFILE
FEAT = C.PIPELINE_CTES
HASH = f"md5(concat_ws('|', CAST({ZONE} AS VARCHAR), CAST(hour AS VARCHAR), '{P.seed}'))"
TEMPORAL = (
    f"CASE WHEN hour < TIMESTAMP '{P.val_start}' THEN 'train' "
    f"WHEN hour < TIMESTAMP '{P.test_start}' THEN 'val' ELSE 'test' END"
)


def _temporal(spark, sf_dir):
    return SP.temporal_split(C.features(spark, sf_dir), P.val_start, P.test_start)


def _keys(spark, sf_dir):
    """(zone, hour) of the feature table, materialised once: positions take a
    counting pass and an assignment pass over it."""
    return C.features_cut(spark, sf_dir, columns=[ZONE, HOUR])


@register(
    "time_positions",
    FEAT + f"SELECT {ZONE}, hour, CAST(row_number() OVER (ORDER BY hour, {ZONE}) - 1 AS BIGINT) AS pos FROM features",
)
def q_time_positions(spark, sf_dir):
    """global 0-based position in (hour, zone) order, via per-hour offsets."""
    return SP.time_positions(_keys(spark, sf_dir))


@register(
    "temporal_split",
    FEAT
    + f"""SELECT split, count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour
FROM (SELECT *, {TEMPORAL} AS split FROM features) GROUP BY 1""",
)
def q_temporal_split(spark, sf_dir):
    """Train / val / test by cutoffs, with the leak check enforced."""
    labelled = _temporal(spark, sf_dir)
    SP.check_split(labelled, P.val_start, P.test_start)
    return SP.split_summary(labelled)


@register(
    "window_split",
    FEAT
    + f"""SELECT split, count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour
FROM (SELECT *, CASE WHEN hour < TIMESTAMP '{P.alt_val_start}' THEN 'train'
  WHEN hour < TIMESTAMP '{P.alt_val_end}' THEN 'val' ELSE 'unused' END AS split FROM features) GROUP BY 1""",
)
def q_window_split(spark, sf_dir):
    """The alternate one-week validation window."""
    labelled = SP.window_split(C.features(spark, sf_dir), P.alt_val_start, P.alt_val_end)
    SP.check_split(labelled, P.alt_val_start)
    return SP.split_summary(labelled)


_RANDOM_SQL = (
    FEAT
    + f""", ranked AS (SELECT {ZONE}, hour, row_number() OVER (ORDER BY {HASH}) - 1 AS pos, count(*) OVER () AS n FROM features),
sized AS (SELECT *, ceil(CAST(n AS DOUBLE) * 0.2) AS n_test FROM ranked),
labelled AS (SELECT {ZONE}, hour, CASE WHEN pos < n_test THEN 'test'
  WHEN pos < n_test + ceil(CAST(n - n_test AS DOUBLE) * 0.25) THEN 'val' ELSE 'train' END AS split FROM sized)
"""
)


@register("random_split", _RANDOM_SQL + "SELECT * FROM labelled")
def q_random_split(spark, sf_dir):
    """Exact 60/20/20 split in seeded md5 order (membership per row)."""
    return SP.random_split(_keys(spark, sf_dir), seed=P.seed)


@register("random_split_sizes", _RANDOM_SQL + "SELECT split, count(*) AS rows FROM labelled GROUP BY 1")
def q_random_split_sizes(spark, sf_dir):
    """Split sizes (ceil(20%) test, ceil(25% of the rest) val)."""
    return SP.random_split(_keys(spark, sf_dir), seed=P.seed).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "time_series_folds",
    FEAT
    + f"""SELECT {ZONE}, hour, pos, test_fold, CAST(first + (test_fold - 1) * size AS BIGINT) AS fold_start FROM (
  SELECT {ZONE}, hour, pos, first, size,
    CASE WHEN pos >= first THEN CAST(floor((pos - first) / size) + 1 AS INTEGER) END AS test_fold
  FROM (SELECT {ZONE}, hour, row_number() OVER (ORDER BY hour, {ZONE}) - 1 AS pos,
          count(*) OVER () - {P.folds} * (count(*) OVER () // {P.folds + 1}) AS first,
          count(*) OVER () // {P.folds + 1} AS size FROM features))""",
)
def q_time_series_folds(spark, sf_dir):
    """I4: expanding time-series folds (test block n // (k+1) rows)."""
    return SP.time_series_folds(_keys(spark, sf_dir), P.folds)


@register(
    "shuffled_folds",
    FEAT
    + f"""SELECT {ZONE}, hour, CAST(CASE WHEN pos < r * (q + 1) THEN floor(pos / (q + 1))
  ELSE r + floor((pos - r * (q + 1)) / q) END AS INTEGER) AS fold FROM (
  SELECT {ZONE}, hour, row_number() OVER (ORDER BY {HASH}) - 1 AS pos,
    count(*) OVER () // {P.folds} AS q, count(*) OVER () % {P.folds} AS r FROM features)""",
)
def q_shuffled_folds(spark, sf_dir):
    """Shuffled K-fold labels (first n mod k folds one row larger)."""
    return SP.shuffled_folds(_keys(spark, sf_dir), P.folds, P.seed)


@register(
    "zero_share_by_split",
    FEAT
    + f"""SELECT split, round(avg(CAST(demand = 0 AS DOUBLE)) * 100.0, 6) AS zero_pct,
  count(*) FILTER (WHERE demand > 0) AS n_nonzero, count(*) AS n_total
FROM (SELECT *, {TEMPORAL} AS split FROM features) GROUP BY 1""",
)
def q_zero_share_by_split(spark, sf_dir):
    """Zero-demand share per temporal split."""
    return round_doubles(zero_share(_temporal(spark, sf_dir), ["split"]))


@register(
    "train_val_rows",
    FEAT
    + f"""SELECT count(*) AS rows, min(hour) AS first_hour, max(hour) AS last_hour
FROM (SELECT *, {TEMPORAL} AS split FROM features) WHERE split IN ('train', 'val')""",
)
def q_train_val_rows(spark, sf_dir):
    """H1: train + val recombined as a label filter."""
    both = SP.recombine(_temporal(spark, sf_dir), "train", "val")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.min(HOUR).alias("first_hour"), F.max(HOUR).alias("last_hour"))


@register(
    "hour_aligned_folds",
    FEAT
    + f"""SELECT test_fold, count(*) AS rows, count(DISTINCT hour) AS hours, min(hour) AS first_hour, max(hour) AS last_hour
FROM (SELECT hour, CASE WHEN pos >= first THEN CAST(floor((pos - first) / size) + 1 AS INTEGER) END AS test_fold FROM (
  SELECT f.hour, h.pos, h.first, h.size FROM features f JOIN (
    SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS pos,
      count(*) OVER () - {P.folds} * (count(*) OVER () // {P.folds + 1}) AS first,
      count(*) OVER () // {P.folds + 1} AS size FROM (SELECT DISTINCT hour FROM features)) h ON f.hour = h.hour))
GROUP BY 1""",
)
def q_hour_aligned_folds(spark, sf_dir):
    """I4 with ``align='hour'``: expanding folds over whole hours (no hour
    straddles train and test); rows, hours and range per test fold."""
    folds = SP.time_series_folds(_keys(spark, sf_dir), P.folds, align="hour")
    return folds.groupBy("test_fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(HOUR).alias("hours"),
        F.min(HOUR).alias("first_hour"), F.max(HOUR).alias("last_hour"),
    )
