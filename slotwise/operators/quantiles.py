"""Exact quantiles of many columns by bracketing, without gathering or sorting the data.

A quantile is the value at a known rank, so only values around that rank have to be
looked at one by one:

1. one scan takes, for all columns and probabilities at once, the row counts and two
   values of a mergeable sketch (``percentile_approx``) a little below and above the
   rank: a bracket;
2. a second scan deals every value into the brackets of its column or the gaps between
   them.  Gaps are only counted, the values inside a bracket are counted by value, both
   in one partially aggregated ``groupBy``;
3. the counts below give the rank inside each bracket, and the values at the ranks are
   interpolated linearly (pandas / ``quantile_cont`` rule).

A bracket holds about ``4 / accuracy`` of the rows.  Where that is more than ``room``,
it is narrowed by the same sketch over the rows inside it before the exact scan, so no
task ever ranks more than about ``room`` distinct values, whatever the number of rows.
A rank that falls out of its bracket (the sketch's error is a bound, so none should)
widens it and repeats the scan.  A value repeated a billion times is one counter.

:func:`exact_quantiles` by ranges of distinct values is kept as a second way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import cut_lineage


def value_ranks(df: DataFrame, col: str, ranges: int | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` with their 0-based rank span
    ``[first_rank, last_rank]`` in the sorted multiset (checkpointed)."""
    spark = df.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = (
        df.select(F.col(f"`{col}`").cast("double").alias("v"))
        .filter(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    ranged = cut_lineage(counts.repartitionByRange(parts, "v").select("v", "c", F.spark_partition_id().alias("pid")))
    totals = ranged.groupBy("pid").agg(F.sum("c").alias("t"))
    offsets = totals.select(
        "pid", F.coalesce(F.sum("t").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off")
    )
    inside = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.join(offsets, "pid").select(
        "v", "c", (F.col("off") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("first_rank")
    )
    return cut_lineage(ranks.select("v", "first_rank", (F.col("first_rank") + F.col("c") - 1).alias("last_rank")))


def _value_at(ranks: DataFrame, k: Column) -> Column:
    return ranks.filter((F.col("first_rank") <= k) & (F.col("last_rank") >= k)).select(F.max("v")).scalar()


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], ranges: int | None = None) -> list[Column]:
    """Columns (scalar subqueries) holding the exact, linearly interpolated
    quantiles of ``col`` at ``probs``; null when the column has no values."""
    ranks = value_ranks(df, col, ranges)
    n = ranks.select(F.max("last_rank") + 1).scalar()
    out = []
    for p in probs:
        h = (n - 1) * F.lit(float(p))
        lo = F.floor(h)
        hi = F.least(lo + 1, n - 1)
        v_lo, v_hi = _value_at(ranks, lo), _value_at(ranks, hi)
        out.append(v_lo + (h - lo) * (v_hi - v_lo))
    return out


@dataclass
class _Bracket:
    """Values of one column between ``low`` and ``high``, with the rows below and inside."""

    column: str
    prob: float
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0
    spread: float = 0.0

    def inside_of(self, x: Column) -> Column:
        return (x >= F.lit(self.low)) & (x <= F.lit(self.high))


def _sketch(df: DataFrame, x: Mapping[str, Column], brackets: Sequence[_Bracket], ranks: Sequence[float | None], accuracy: int) -> None:
    """Narrow every bracket around its rank (None: its probability) by one scan."""
    aggs = []
    for k, (b, q) in enumerate(zip(brackets, ranks)):
        q = b.prob if q is None else q
        ends = [max(0.0, q - b.spread), min(1.0, q + b.spread)]
        aggs.append(F.percentile_approx(F.when(b.inside_of(x[b.column]), x[b.column]), ends, accuracy).alias(f"e{k}"))
    found = df.agg(*aggs).first()
    for k, b in enumerate(brackets):
        if found[f"e{k}"] is not None:
            b.low, b.high = found[f"e{k}"]


def _count(df: DataFrame, x: Mapping[str, Column], brackets: Sequence[_Bracket]) -> None:
    """Rows below and inside every bracket, by one scan."""
    below = [F.count_if(x[b.column] < F.lit(b.low)).alias(f"b{k}") for k, b in enumerate(brackets)]
    inside = [F.count_if(b.inside_of(x[b.column])).alias(f"i{k}") for k, b in enumerate(brackets)]
    found = df.agg(*below, *inside).first()
    for k, b in enumerate(brackets):
        b.below, b.inside = found[f"b{k}"], found[f"i{k}"]


def _merged(brackets: Sequence[_Bracket]) -> dict[str, list[tuple[float, float]]]:
    """Disjoint ranges per column that cover its brackets, ascending."""
    out: dict[str, list[tuple[float, float]]] = {}
    for b in sorted(brackets, key=lambda b: (b.low, b.high)):
        ranges = out.setdefault(b.column, [])
        if ranges and b.low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], b.high))
        else:
            ranges.append((b.low, b.high))
    return out


def _values_at(df: DataFrame, x: Mapping[str, Column], brackets: Sequence[_Bracket], ranks: Mapping[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks of the columns, where they lie inside the brackets, by one scan.

    Every value becomes one (column, place, value) row: even places are gaps, whose
    values are dropped, odd places are ranges.  Running sums over a range order at most
    its distinct values; the sums over places order a handful of rows.
    """
    entries = []
    for c, ranges in _merged(brackets).items():
        place = F.lit(2 * len(ranges))
        for k in range(len(ranges) - 1, -1, -1):
            low, high = ranges[k]
            place = F.when(x[c] < F.lit(low), 2 * k).when(x[c] <= F.lit(high), 2 * k + 1).otherwise(place)
        entries.append(F.when(x[c].isNotNull(), F.struct(F.lit(c).alias("c"), place.alias("place"), F.when(place % 2 == 1, x[c]).alias("v"))))
    rows = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.c", "e.place", "e.v")
    counts = rows.groupBy("c", "place", "v").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("c", "place").orderBy("v")
    ranked = counts.select("c", "place", "v", "n", F.sum("n").over(inside).alias("upto"), F.sum("n").over(Window.partitionBy("c", "place")).alias("whole"))
    # the rows of all earlier places are known once the last row of each place is
    wanted = []
    cells = cut_lineage(ranked.filter("place % 2 = 1 or upto = whole"))
    places = {(r["c"], r["place"]): r["whole"] for r in cells.select("c", "place", "whole").distinct().collect()}
    for c, found in ranks.items():
        for rank in sorted(found):
            before = 0
            for place in sorted(p for name, p in places if name == c):
                size = places[c, place]
                if before <= rank < before + size and place % 2:
                    wanted.append((c, place, rank, rank - before))
                before += size
    if not wanted:
        return {}
    hit = F.lit(False)
    for c, place, _, at in wanted:
        hit = hit | ((F.col("c") == c) & (F.col("place") == place) & (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
    rows = cells.filter(hit).collect()
    return {(c, rank): r["v"] for c, place, rank, at in wanted for r in rows if r["c"] == c and r["place"] == place and r["upto"] - r["n"] <= at < r["upto"]}


def bracketed_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = 10_000, room: int = 200_000
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles per column; None for a column without values (nulls and NaN are none)."""
    x = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in wanted}
    data = df.select(*[v.alias(f"q{k}") for k, v in enumerate(x.values())])
    x = {c: F.col(f"q{k}") for k, c in enumerate(x)}
    brackets = [_Bracket(c, p, spread=2.0 / accuracy) for c, probs in wanted.items() for p in dict.fromkeys(probs)]
    if not brackets:
        return {c: [] for c in wanted}
    counted = data.agg(*[F.count(v).alias(f"n{k}") for k, v in enumerate(x.values())], *[
        F.percentile_approx(x[b.column], [max(0.0, b.prob - b.spread), min(1.0, b.prob + b.spread)], accuracy).alias(f"e{k}") for k, b in enumerate(brackets)
    ]).first()
    sizes = {c: counted[f"n{k}"] for k, c in enumerate(x)}
    for k, b in enumerate(brackets):
        b.inside = sizes[b.column]
        if counted[f"e{k}"] is not None:
            b.low, b.high = counted[f"e{k}"]
    at = {(b.column, b.prob): (sizes[b.column] - 1) * b.prob for b in brackets if sizes[b.column]}
    ranks: dict[str, set[int]] = {}
    for (c, _), h in at.items():
        ranks.setdefault(c, set()).update((math.floor(h), min(math.floor(h) + 1, sizes[c] - 1)))
    expected, before = max(sizes.values()) * 4.0 / accuracy, math.inf
    while expected > room:  # rows inside a bracket, distinct or not
        _count(data, x, brackets)
        live = [b for b in brackets if b.inside > room and b.low < b.high]
        held = sum(b.inside for b in live)
        if not live or held >= before:  # nothing left but repeated values
            break
        _sketch(data, x, live, [(at[b.column, b.prob] - b.below) / b.inside for b in live], accuracy)
        expected, before = max(b.inside for b in live) * 4.0 / accuracy, held
    values: dict[tuple[str, int], float] = {}
    open_ = [b for b in brackets if sizes[b.column]]
    while open_:
        values |= _values_at(data, x, open_, ranks)
        missing = {c: {r for r in found if (c, r) not in values} for c, found in ranks.items()}
        ranks = {c: found for c, found in missing.items() if found}
        open_ = [b for b in open_ if b.column in ranks]
        for b in open_:  # an end for all: the rest of the column
            b.low, b.high = -math.inf, math.inf
    out: dict[str, list[float | None]] = {}
    for c, probs in wanted.items():
        out[c] = []
        for p in probs:
            if not sizes[c]:
                out[c].append(None)
                continue
            h = at[c, p]
            low, high = values[c, math.floor(h)], values[c, min(math.floor(h) + 1, sizes[c] - 1)]
            out[c].append(low + (h - math.floor(h)) * (high - low))
    return out
