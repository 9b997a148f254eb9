"""Scalar and aggregate expression helpers that are safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` with null instead of a division error."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def pct_vs_typical(prediction: str | Column, typical: str | Column) -> Column:
    """Percent above/below the historical mean, 0 when the mean is <= 0."""
    p, h = _c(prediction), _c(typical)
    return F.when(h > 0, (p - h) / h * 100.0).otherwise(F.lit(0.0))


def unbiased_skewness(col: str | Column) -> Column:
    """Sample skewness with the (n(n-1))^0.5/(n-2) correction;
    0 for a constant column of at least three values."""
    x = _c(col)
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1.0)), n - 2.0)
    return F.when((n >= 3) & (F.min(x) == F.max(x)), F.lit(0.0)).otherwise(corrected)


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation that is null (not an error) for a constant column."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def hour_label(hour: str | Column) -> Column:
    """12-hour label such as ``12 AM``, ``1 PM``."""
    h = _c(hour)
    twelve = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.concat(twelve.cast("string"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))


def signed_pct_label(value: str | Column) -> Column:
    """``+12.3%`` / ``-4.0%``: a plus sign only for positive values, one
    decimal rounded half away from zero."""
    v = _c(value)
    sign = F.when(v > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, F.format_string("%.1f", F.round(v, 1)), F.lit("%"))


def round6(col: str | Column) -> Column:
    return F.round(_c(col), 6)
