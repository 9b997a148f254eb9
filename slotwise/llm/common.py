"""Helpers shared by the operators: lineage cuts, Arrow text buffers, hashing.

``materialise`` writes a table in the shared checkpoint folder and reads it
back, so later stages re-read files that survive a lost executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from slotwise.session import ensure_checkpoint_dir

# odd 64-bit multipliers (fixed values: golden ratio and the two splitmix64 steps)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Text of this many bytes is handled at once inside a task; bounds the scratch arrays.
CHUNK_BYTES = 1 << 21


def materialise(df: DataFrame, partition_cols: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a table that :func:`materialise` returned and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64 (wraps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of the batch by name."""
    return batch.column(batch.schema.get_field_index(name))


def large_text(array: pa.Array) -> pa.Array:
    """A string column as large_string with nulls as empty texts and offset 0."""
    import pyarrow.compute as pc

    out = pc.fill_null(array.cast(pa.large_string()), "")
    return pa.concat_arrays([out]) if out.offset else out


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (uint8) and the n+1 offsets of a null-free large_string array."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if array.offset:
        array = pa.concat_arrays([array])
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(array) + 1)
    if data is None:
        return np.zeros(0, np.uint8), offs
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def text_chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a large_string array of at most ``limit`` bytes (one row at least)."""
    if not len(array):
        return
    offs = np.frombuffer(array.buffers()[1], np.int64, count=len(array) + 1 + array.offset)[array.offset :]
    start = 0
    while start < len(array):
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(array))
        yield start, stop
        start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that never cross a text.

    ``is_word`` is a 256-entry boolean table.  Returns starts, ends and the
    text index of every run.
    """
    inside = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = bool(len(data)) and bool(inside[0])
    edge[-1] = bool(len(data)) and bool(inside[-1])
    starts_mask = inside.copy()
    if len(data) > 1:
        starts_mask[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts_mask[cuts] = inside[cuts]
    ends_mask = inside.copy()
    if len(data) > 1:
        ends_mask[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[cuts > 0]
    ends_mask[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(starts_mask)
    ends = np.flatnonzero(ends_mask) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of bytes (polynomial of the bytes, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    pos = np.arange(total) - np.repeat(first, lens)
    powers = np.multiply.accumulate(np.full(int(lens.max()), GOLDEN, np.uint64))
    values = (data[pos + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * powers[pos]
    return mix64(np.add.reduceat(values, first) ^ (lens.astype(np.uint64) * MIX_B))


def as_signed(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 with the same bits (Spark has no unsigned type)."""
    return x.view(np.int64)
