"""Vector compression: product codes from integer Lloyd rounds that only recheck what moved.

Each component x becomes the integer floor(4096*x).  A vector is cut into equal
parts, each position with its own codebook.  A round assigns every part to its
nearest entry (squared Euclidean distance, lower index on ties) and then moves every
entry to the componentwise floor of its parts' mean.

A part keeps its entry and the exact distance to it between rounds.  If that entry
did not move, every other unmoved entry is still no better than it was, so the part
compares only the moved entries with its stored distance; on equal distances the
lower index wins.  A part whose entry moved compares all entries again.

Each round is one map-only pass: the tasks read the state of the round before, write
the new one and, beside it, the sums and counts of their parts per entry.  The state
lies in the shared folder, so an executor lost later costs no earlier round; the
table of the round before is removed when its successor is complete.  Only codebooks
and the sums per entry, both of a size that the codebooks fix, reach the driver.

Cases.  Rows are dropped whose vector is null, holds a null or non-finite component
or has a length other than that of the smallest kept id's vector, which must be a
positive multiple of the number of parts (smallest by id, nulls last, then by the
vector).  Fewer rows than entries give a smaller codebook.  Repeated ids are rows of
their own.  Null labels count as one label.  All integers are exact: sums travel in
limbs of 32 bits, and parts whose distance passes 62 bits are computed with unbounded
integers; an ``error`` or ``label_error`` beyond a 64-bit integer is null.  An empty
table gives no rows.  Input columns of the same names as the result's give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import column, discard, materialise, read_table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: A label with more than one in this many rows is joined by a broadcast of at most this many rows.
HOT_SHARE = 200
LIMB = 32
_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """Entries by part: ``entries[part][entry]`` is a tuple of integers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    def digest(self) -> str:
        """SHA-256 of all components in order of part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def moved(self, before: Codebooks | None) -> list[list[bool]] | None:
        """Per part and entry, whether it differs from the book before (None: there was none)."""
        if before is None:
            return None
        return [[a != b for a, b in zip(now, old)] for now, old in zip(self.entries, before.entries)]


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(4096*x), exact: int64 where all results are below 2**40, else Python integers."""
    values = values.astype(np.float64)
    if not values.size or float(np.abs(values).max()) < (1 << 40) / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    # beyond 2**53 a float is an integer, so it is scaled as one
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in values.ravel().tolist()], object).reshape(values.shape)


def _distances(points: np.ndarray, entry: tuple[int, ...]) -> np.ndarray:
    """Exact squared distances of the rows of ``points`` to one entry."""
    size = points.shape[1]
    if points.dtype != object and (not points.size or (max(int(np.abs(points).max()), *map(abs, entry)) * 2) ** 2 * size < 1 << 62):
        gap = points - np.array(entry, np.int64)
        return np.einsum("ij,ij->i", gap, gap)
    gap = points.astype(object) - np.array(entry, object)
    return (gap * gap).sum(axis=1)


def reassign(
    points: np.ndarray, entries: Sequence[tuple[int, ...]], moved: Sequence[bool] | None, code: np.ndarray, distance: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """New entry and distance of every row of ``points`` for one part.

    ``code`` and ``distance`` are those of the round before.  Where ``moved`` is None,
    the row's own entry moved or no distance is stored (-1), all entries are compared,
    else only the moved ones.
    """
    if moved is None:
        scan = np.ones(len(points), bool)
    else:
        scan = np.array(moved, bool)[code] | (distance < 0)
    code = code.copy()
    distance = distance.astype(object) if points.dtype == object else distance.copy()
    for k, entry in enumerate(entries):
        rows = np.arange(len(points)) if moved is None or moved[k] else np.flatnonzero(scan)
        if not len(rows):
            continue
        new = _distances(points[rows], entry)
        if new.dtype == object and distance.dtype != object:
            distance = distance.astype(object)
        first = scan[rows] & (k == 0)
        better = first | (new < distance[rows]) | ((new == distance[rows]) & (k < code[rows]))
        better = better.astype(bool)
        code[rows[better]], distance[rows[better]] = k, new[better]
    return code, distance


def _limbs(value: int) -> list[int]:
    """Signed integer as base 2**32 digits, lowest first; only the last can be negative."""
    out = []
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        value, low = divmod(value, 1 << LIMB)
        out.append(low)
    return [*out, value]


def kept(df: DataFrame, id_col: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """The rows that take part as (id, vector, label), and the length of their vectors (0: none)."""
    x = F.col("vec")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("vec"), F.col(f"`{label}`").alias("label"))
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = rows.filter(x.isNotNull() & whole)
    first = rows.filter((F.size(x) > 0) & (F.size(x) % parts == 0)).orderBy(F.col("id").asc_nulls_last(), x).limit(1).select(F.size(x)).collect()
    length = first[0][0] if first else 0
    return rows.filter(F.size(x) == length), length


def _matrix(array: pa.Array, length: int) -> np.ndarray:
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), length)


def _round(state: DataFrame, books: Codebooks, moved: list[list[bool]] | None, length: int) -> DataFrame:
    """State rows and, at the end of every task, its sums per part and entry (kind 1)."""
    parts = len(books.entries)
    width = length // parts
    fields = [state.schema[c] for c in ("id", "vec", "label")]
    out = T.StructType(
        [
            *fields,
            T.StructField("codes", T.BinaryType()),
            T.StructField("dist", T.ArrayType(T.LongType())),
            T.StructField("part", T.IntegerType()),
            T.StructField("entry", T.IntegerType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("amount", T.LongType()),
            T.StructField("kind", T.IntegerType()),
        ]
    )
    first = moved is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        sums = [[[0] * width for _ in book] for book in books.entries]
        counts = [[0] * len(book) for book in books.entries]
        for whole in batches:
            for start in range(0, len(whole), 4096):
                batch = whole.slice(start, 4096)
                points = scaled(_matrix(column(batch, "vec"), length))
                if first:
                    codes = np.zeros((len(batch), parts), np.uint8)
                    dist = np.full((len(batch), parts), -1, np.int64)
                else:
                    codes = np.frombuffer(b"".join(column(batch, "codes").to_pylist()), np.uint8).reshape(-1, parts)
                    dist = _matrix(column(batch, "dist"), parts)
                new_codes, new_dist = [], []
                for p, book in enumerate(books.entries):
                    mine = points[:, p * width : (p + 1) * width]
                    code, far = reassign(mine, book, moved[p] if moved else None, codes[:, p].astype(np.int64), dist[:, p])
                    new_codes.append(code.astype(np.uint8))
                    new_dist.append([int(d) if d <= _MOST else -1 for d in far] if far.dtype == object else far)
                    for k in np.unique(code).tolist():
                        chosen = mine[code == k]
                        counts[p][k] += len(chosen)
                        total = chosen.sum(axis=0)  # 4096 rows below 2**40, or Python integers
                        sums[p][k] = [a + int(b) for a, b in zip(sums[p][k], total)]
                rows = len(batch)
                packed = np.stack(new_codes, axis=1)
                flat = np.stack([np.asarray(d, np.int64) for d in new_dist], axis=1).ravel()
                none = pa.nulls(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column(batch, c).cast(schema.field(c).type) for c in ("id", "vec", "label")],
                        pa.array([r.tobytes() for r in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * parts, pa.int32()), pa.array(flat)).cast(schema.field("dist").type),
                        none,
                        none,
                        none,
                        pa.nulls(rows, pa.int64()),
                        pa.array(np.zeros(rows, np.int32)),
                    ],
                    schema=schema,
                )
        found = [
            (p, k, slot * 64 + limb, digit)
            for p, book in enumerate(books.entries)
            for k in range(len(book))
            if counts[p][k]
            for slot, value in enumerate([counts[p][k], *sums[p][k]])
            for limb, digit in enumerate(_limbs(value))
        ]
        if found:
            lists = [pa.array(list(x), t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
            empty = [pa.nulls(len(found), schema.field(c).type) for c in ("id", "vec", "label", "codes", "dist")]
            yield pa.RecordBatch.from_arrays([*empty, *lists, pa.array(np.ones(len(found), np.int32))], schema=schema)

    cols = ["id", "vec", "label"] + ([] if first else ["codes", "dist"])
    return state.select(*cols).mapInArrow(run, out)


def _means(written: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """The codebooks moved to the floor of the means; unused entries stay.

    The digits of the tasks are added in Spark, as decimals, before they reach the driver."""
    digits = written.filter("kind = 1").groupBy("part", "entry", "slot").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    totals: dict[tuple[int, int], list[int]] = {}
    for r in digits.collect():
        values = totals.setdefault((r["part"], r["entry"]), [0] * (width + 1))
        values[r["slot"] // 64] += int(r["amount"]) << LIMB * (r["slot"] % 64)
    return Codebooks(
        tuple(
            tuple(tuple(s // totals[p, k][0] for s in totals[p, k][1:]) if (p, k) in totals else entry for k, entry in enumerate(book))
            for p, book in enumerate(books.entries)
        )
    )


def first_books(rows: DataFrame, length: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    points = scaled(np.array([r["vec"] for r in found], np.float64).reshape(len(found), length))
    width = length // parts
    return Codebooks(tuple(tuple(tuple(int(x) for x in v[p * width : (p + 1) * width]) for v in points) for p in range(parts)))


def compress(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """(id, label, codes, dist) of every kept row and the final codebooks.

    ``codes`` holds one byte per part, ``dist`` the exact squared distances (-1 where
    one passes 64 bits).  At most 256 entries.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("parts >= 1, 1 <= entries <= 256 and rounds >= 0 are needed")
    rows, length = kept(df, id_col, vector, label, parts)
    if not length:
        schema = T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("dist", T.ArrayType(T.LongType()))])
        return df.sparkSession.createDataFrame([], schema).drop("vec"), Codebooks(((),) * parts)
    books, before, state, table = first_books(rows, length, parts, entries), None, rows, None
    for r in range(rounds + 1):
        written = materialise(_round(state, books, books.moved(before), length), partition_cols=["kind"])
        if table is not None:
            discard(table)
        table, state = written, written.filter("kind = 0")
        if r < rounds:
            before, books = books, _means(written, books, length // parts)
    return state.select("id", "label", "codes", "dist"), books


def with_label_error(errors: DataFrame) -> DataFrame:
    """``errors`` (label, error, ...) with the sum of ``error`` over rows of the same label.

    A label of more than one in HOT_SHARE rows comes from a broadcast of at most
    HOT_SHARE rows, so no task gathers its rows; the others meet their sums in a shuffle.
    """
    exact = F.col("error").cast("decimal(38,0)")
    sums = materialise(errors.groupBy("label").agg(F.sum(exact).alias("__sum"), F.count(F.lit(1)).alias("__rows"), F.count("error").alias("__known")))
    total = sums.agg(F.sum("__rows")).first()[0] or 0
    fits = (F.col("__sum") <= F.lit(_MOST).cast("decimal(38,0)")) & (F.col("__known") == F.col("__rows"))
    sums = sums.select(F.col("label").alias("__label"), F.when(fits, F.col("__sum").cast("long")).alias("label_error"), (F.col("__rows") * HOT_SHARE > total).alias("__hot"))
    hot, cold = sums.filter("__hot").drop("__hot"), sums.filter("not __hot").drop("__hot")
    same = F.col("label").eqNullSafe(F.col("__label"))
    often = errors.join(F.broadcast(hot), same).drop("__label")
    seldom = errors.join(F.broadcast(hot.select("__label")), same, "left_anti").join(cold, same).drop("__label")
    return often.unionByName(seldom)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    state, books = compress(read_table(spark, sf_dir, "embeddings"))
    one = F.aggregate("dist", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)"))
    error = F.when(~F.exists("dist", lambda d: d < 0) & (one <= F.lit(_MOST).cast("decimal(38,0)")), one.cast("long"))
    errors = state.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), error.alias("error"), "label")
    return with_label_error(errors).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """The rounds as a chain of common table expressions."""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    w = "(len(v) // 8)"
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda f: CAST(floor(4096 * CAST(f AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda f: f IS NOT NULL AND isfinite(f)))),
parts AS MATERIALIZED (SELECT rid, p, v[p * {w} + 1:(p + 1) * {w}] AS x FROM kept, range(8) r(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS k, x AS e FROM parts WHERE rid <= 16),
"""
    for r in range(ROUNDS + 1):
        sql += f"""a{r} AS MATERIALIZED (SELECT rid, p, any_value(x) AS x, min(d * 256 + k) % 256 AS k, min(d) AS d
  FROM (SELECT rid, p, x, k, {gap} AS d FROM parts JOIN c{r} USING (p)) GROUP BY rid, p),
"""
        if r < ROUNDS:
            sql += f"""m{r} AS (SELECT p, k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) WHERE i <= len(x) GROUP BY p, k, i),
c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(n.e, c{r}.e) AS e FROM c{r}
  LEFT JOIN (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM m{r} GROUP BY p, k) n USING (p, k)),
"""
    return (
        sql
        + f"""coded AS (SELECT rid, string_agg(format('{{:02x}}', CAST(k AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid) CROSS JOIN book"""
    )


OP12_SQL = _op12_sql()
