"""Row positions, splits and folds as label columns.

Spark rows have no order, so every positional rule (time-series folds, exact
random split sizes) starts from an explicit position column computed without
an unpartitioned window over the data:

* rows are grouped into ordered buckets (the hour, or a hash prefix);
* the per-bucket counts - one row per bucket, bounded by the calendar length
  or by the number of hash buckets, never by the data - get a running sum;
* each row's position is its bucket offset plus its rank inside the bucket
  (a window partitioned by bucket).

Labels need no position of every row.  A label changes at a few positions only
(two for a train/val/test split, one per fold), and the key of the row at such
a position separates the labels: :func:`labels_by_cuts` ranks only the rows of
the buckets that hold a cut, and labels all rows by comparing their key with
the few separating keys, without a window, join or shuffle of the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.schemas import CV_FOLDS, HOUR, RANDOM_SEED, TEST_FRACTION, VAL_FRACTION_OF_REST, ZONE


def positions(df: DataFrame, bucket: Column, order: list[Column], name: str = "pos") -> DataFrame:
    """0-based global position in ``(bucket, *order)`` order.

    ``bucket`` must be coarse (hours, hash prefixes); rows within a bucket are
    ranked by ``order``, which must make the order total for reproducibility.
    """
    keyed = df.select("*", bucket.alias("__b"))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # one row per bucket: the running sum runs over a small, bounded table
    offsets = counts.select(
        "__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off")
    )
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    joined = keyed.join(offsets, "__b")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + rank).cast("long").alias(name))


def time_positions(df: DataFrame, hour_col: str = HOUR, zone_col: str = ZONE, name: str = "pos") -> DataFrame:
    """position after sorting by (hour, zone)."""
    return positions(df, F.col(hour_col), [F.col(zone_col)], name)


def hash_key(zone_col: str = ZONE, hour_col: str = HOUR, seed: int = RANDOM_SEED) -> Column:
    """Seeded, partition-independent shuffle key: md5 of ``zone|hour|seed``."""
    return F.md5(F.concat_ws("|", F.col(zone_col).cast("string"), F.col(hour_col).cast("string"), F.lit(str(seed))))


def hash_positions(
    df: DataFrame, zone_col: str = ZONE, hour_col: str = HOUR, seed: int = RANDOM_SEED, name: str = "pos", prefix_hex: int = 4
) -> DataFrame:
    """Position in seeded hash order; buckets are the first ``prefix_hex`` hex
    digits of the hash (16^4 = 65,536 uniform buckets)."""
    h = hash_key(zone_col, hour_col, seed)
    keyed = df.select("*", h.alias("__h"))
    out = positions(keyed, F.substring("__h", 1, prefix_hex), [F.col("__h")], name)
    return out.drop("__h")


def _count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def labels_by_cuts(df: DataFrame, bucket: Column, key: Column, cuts: Sequence[Column]) -> Column:
    """Number of ``cuts`` (ascending 0-based positions in key order) at or before each row's position.

    ``bucket`` must be a coarse, monotone function of ``key``.  The table is read once for the
    bucket counts and once for the rows of the at most ``len(cuts)`` buckets that hold a cut;
    only these are ranked.  The label itself is a comparison with the separating keys (one
    row, a scalar subquery).  Rows of equal keys get one label, that of the first of them.
    A cut at or beyond the number of rows is never reached.
    """
    if not cuts:
        return F.lit(0)
    keyed = df.select(bucket.alias("__b"), key.alias("__k"))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__b", "__n", F.coalesce(before, F.lit(0)).alias("__off"))
    held = offsets.select("*", F.posexplode(F.array(*[c.cast("long") for c in cuts])).alias("__i", "__cut")).filter(
        (F.col("__cut") >= F.col("__off")) & (F.col("__cut") < F.col("__off") + F.col("__n"))
    )
    # at most one row per cut
    inside = keyed.join(F.broadcast(held.withColumnRenamed("__b", "__h")), F.col("__b").eqNullSafe(F.col("__h")))
    rank = F.row_number().over(Window.partitionBy("__i").orderBy("__k")) - 1
    at_cut = inside.select("__i", "__k", (rank == F.col("__cut") - F.col("__off")).alias("__at")).filter("__at")
    keys = at_cut.agg(F.struct(*[F.max(F.when(F.col("__i") == i, F.col("__k"))).alias(f"k{i}") for i in range(len(cuts))])).scalar()
    label = F.lit(0)
    for i in range(len(cuts)):
        label = label + F.coalesce(key >= keys.getField(f"k{i}"), F.lit(False)).cast("int")
    return label


def _hash_labels(df: DataFrame, zone_col: str, hour_col: str, seed: int, cuts: Sequence[Column], prefix_hex: int = 4) -> Column:
    """:func:`labels_by_cuts` in seeded hash order."""
    h = hash_key(zone_col, hour_col, seed)
    return labels_by_cuts(df, F.substring(h, 1, prefix_hex), h, cuts)


def time_slice(df: DataFrame, start: str | None = None, end: str | None = None, hour_col: str = HOUR) -> DataFrame:
    """Rows with ``start <= hour < end`` (either bound optional).

    When the table carries the ``date`` partition column (as the written
    feature table does), the matching date range is added so the scan prunes
    whole partitions instead of filtering rows.
    """
    h = F.col(hour_col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (h >= F.lit(start).cast("timestamp_ntz"))
        if "date" in df.columns:
            cond = cond & (F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        cond = cond & (h < F.lit(end).cast("timestamp_ntz"))
        if "date" in df.columns:
            cond = cond & (F.col("date") <= F.to_date(F.lit(end)))
    return df.filter(cond)


def temporal_split(df: DataFrame, val_start: str, test_start: str, hour_col: str = HOUR) -> DataFrame:
    """``split`` = train (< val_start), val (< test_start) or test."""
    h = F.col(hour_col)
    split = (
        F.when(h < F.lit(val_start).cast("timestamp_ntz"), "train")
        .when(h < F.lit(test_start).cast("timestamp_ntz"), "val")
        .otherwise("test")
    )
    return df.select("*", split.alias("split"))


def window_split(df: DataFrame, val_start: str, val_end: str, hour_col: str = HOUR) -> DataFrame:
    """Train before ``val_start``, val in ``[val_start, val_end)``, rest unused."""
    h = F.col(hour_col)
    split = (
        F.when(h < F.lit(val_start).cast("timestamp_ntz"), "train")
        .when(h < F.lit(val_end).cast("timestamp_ntz"), "val")
        .otherwise("unused")
    )
    return df.select("*", split.alias("split"))


def split_summary(df: DataFrame, hour_col: str = HOUR) -> DataFrame:
    """Rows and time range per split (the input of the leak check)."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(hour_col).alias("first_hour"), F.max(hour_col).alias("last_hour")
    )


def check_split(df: DataFrame, val_start: str, test_start: str | None = None, hour_col: str = HOUR) -> None:
    """Leak check: train ends before val starts, test starts at or after the
    test cutoff, and no named split is empty.  Collects one row per split."""
    rows = {r["split"]: r for r in split_summary(df, hour_col).collect()}
    import datetime as _dt

    vs = _dt.datetime.fromisoformat(val_start)
    for name in ("train", "val") + (("test",) if test_start else ()):
        if name not in rows or rows[name]["rows"] == 0:
            raise ValueError(f"split {name!r} is empty")
    if rows["train"]["last_hour"] >= vs:
        raise ValueError("train overlaps validation")
    if test_start and rows["test"]["first_hour"] < _dt.datetime.fromisoformat(test_start):
        raise ValueError("test starts before the test cutoff")


def random_split(
    df: DataFrame,
    seed: int = RANDOM_SEED,
    test_fraction: float = TEST_FRACTION,
    val_fraction: float = VAL_FRACTION_OF_REST,
    zone_col: str = ZONE,
    hour_col: str = HOUR,
) -> DataFrame:
    """Exact-size random train/val/test (e.g. 60/20/20) in seeded hash order.

    ``ceil(test_fraction * n)`` rows go to test, then ``ceil(val_fraction *
    rest)`` to val.  Membership does not depend on partitioning; rows of equal
    (zone, hour) stay together.
    """
    n = _count(df)
    n_test = F.ceil(n * F.lit(test_fraction))
    n_val = F.ceil((n - n_test) * F.lit(val_fraction))
    label = _hash_labels(df, zone_col, hour_col, seed, [n_test, n_test + n_val])
    return df.select("*", F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train")), label + 1).alias("split"))


def time_series_blocks(df: DataFrame, k: int = CV_FOLDS, hour_col: str = HOUR, zone_col: str = ZONE) -> DataFrame:
    """I4 as labels only: ``test_fold`` of :func:`time_series_folds`, without positions.

    Fold f trains on the rows before its block: ``test_fold`` null or below f.
    """
    return df.select("*", block_label(df, k, hour_col, zone_col).alias("test_fold"))


def block_label(df: DataFrame, k: int = CV_FOLDS, hour_col: str = HOUR, zone_col: str = ZONE) -> Column:
    """The label of :func:`time_series_blocks` as a column for rows of ``df``."""
    n = _count(df)
    size = F.floor(n / F.lit(k + 1))
    cuts = [n - F.lit(k - f) * size for f in range(k)]
    return F.nullif(labels_by_cuts(df, F.col(hour_col), F.struct(hour_col, zone_col), cuts), F.lit(0))


def time_series_folds(
    df: DataFrame, k: int = CV_FOLDS, hour_col: str = HOUR, zone_col: str = ZONE, align: str = "row"
) -> DataFrame:
    """I4: expanding-window folds by time position.

    Test block size is ``n // (k + 1)``; fold f (1..k) tests positions
    ``[n - (k - f + 1) * size, n - (k - f) * size)`` and trains on every
    earlier position.  Adds ``pos`` and ``test_fold`` (null when a row is in no
    test block); the training rows of fold f are ``pos < fold_start(f)``.

    ``align='row'`` counts rows (an hour can straddle train and test, as a
    positional splitter does); ``align='hour'`` counts whole hours, so every
    hour lands in one block: ``pos`` is then the hour's index.
    """
    if align == "hour":
        hours = df.select(hour_col).distinct()
        index = positions(hours, F.col(hour_col), [F.col(hour_col)])  # one row per hour
        pos = df.join(index, hour_col)
        n = _count(hours)
    elif align == "row":
        pos = time_positions(df, hour_col, zone_col)
        n = _count(df)
    else:
        raise ValueError("align must be 'row' or 'hour'")
    size = F.floor(n / F.lit(k + 1))
    first = n - F.lit(k) * size
    fold = F.when(F.col("pos") >= first, F.floor((F.col("pos") - first) / size) + 1).cast("int")
    return pos.select("*", fold.alias("test_fold"), first.alias("__first"), size.alias("__size")).select(
        *[F.col(f"`{c}`") for c in df.columns],
        "pos",
        "test_fold",
        (F.col("__first") + (F.col("test_fold") - 1) * F.col("__size")).alias("fold_start"),
    )


def shuffled_folds(
    df: DataFrame, k: int = CV_FOLDS, seed: int = RANDOM_SEED, zone_col: str = ZONE, hour_col: str = HOUR
) -> DataFrame:
    """K shuffled folds (0-based ``fold``); the first ``n mod k`` folds hold
    one row more, as in a shuffled K-fold."""
    n = _count(df)
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    cuts = [F.lit(f) * q + F.least(F.lit(f), r) for f in range(1, k)]
    return df.select("*", _hash_labels(df, zone_col, hour_col, seed, cuts).alias("fold"))


def recombine(df: DataFrame, *splits: str) -> DataFrame:
    """H1: union of named splits as a filter on the label (no copies)."""
    return df.filter(F.col("split").isin(*splits))


def fold_sizes(n: int, k: int = CV_FOLDS) -> list[int]:
    """Sizes of shuffled folds for ``n`` rows (for tests and reports)."""
    q, r = divmod(n, k)
    return [q + 1] * r + [q] * (k - r)


def split_sizes(n: int, test_fraction: float = TEST_FRACTION, val_fraction: float = VAL_FRACTION_OF_REST) -> tuple[int, int, int]:
    """(train, val, test) sizes of :func:`random_split` for ``n`` rows."""
    n_test = math.ceil(test_fraction * n)
    n_val = math.ceil(val_fraction * (n - n_test))
    return n - n_test - n_val, n_val, n_test
