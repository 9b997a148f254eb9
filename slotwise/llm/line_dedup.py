"""Line dedup: sharded cuckoo filters over an exact reference-count table.

State (``LineIndex``), all of it Spark tables in the shared folder:

* ``postings`` (k1, k2, doc_id): which document holds which line key.  It is
  the exact reference table: the count of a key is its number of postings.
* ``counts`` (k1, k2, refs, last_doc): keys found in at least ``min_docs``
  documents with their number of holders and the largest holder.
* ``filters`` (shard, buckets): one cuckoo filter per shard of the keys in
  ``counts``.  A filter answers "certainly not repeated" for nearly every line,
  so only its hits meet the exact table.

Documents can be inserted and deleted; only the keys they hold are counted
again, and keys that cross ``min_docs`` are added to or removed from their
filter, so a deletion undoes an insertion.

Line keys are 128 bits of xxh3 over the stripped, ASCII-lower-cased line.  Counts
are partially aggregated before the shuffle, probes are dealt by
(shard, salt): a key held by a third of all documents meets no single task.

Defined cases: a null text is one empty line; rows of equal ``doc_id`` count
as one holder; a row with a null ``doc_id`` counts as no holder but loses its
repeated lines.  Columns besides ``doc_id`` and ``text`` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import GOLDEN, MIX_A, column, materialise, mix64, read_table

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of one filter shard; bounds the memory of a probing or building task.
SHARD_KEYS = 50_000
#: Postings that meet one copy of a shard's filter.
PROBE_ROWS = 200_000
SLOTS = 4
#: Bytes [\x20\x09-\x0D], stripped at both ends of a line.
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"


class CuckooFilter:
    """A cuckoo filter: buckets of four 16-bit fingerprints, two buckets a key."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(n_keys, 1) / (SLOTS * 0.8) + 1))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = (mix64(k2.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (mix64(k1.view(np.uint64) ^ GOLDEN) & mask).astype(np.int64)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        return bucket ^ (mix64(fp.astype(np.uint64) * MIX_A) & mask).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(k1, k2)
        return (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Insert every key; False if one found no place (the filter must grow)."""
        fps, firsts, others = (x.tolist() for x in self._places(k1, k2))
        state = 0x2545F491
        for fp, a, b in zip(fps, firsts, others):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = fp
                    break
            else:
                bucket = b
                for _ in range(500):
                    state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                    slot = (state >> 16) % SLOTS
                    fp, self.table[bucket, slot] = int(self.table[bucket, slot]), fp
                    bucket = int(self._other(np.array([bucket]), np.array([fp], np.uint16))[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = fp
                        break
                else:
                    return False
        return True

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Delete keys that were inserted before."""
        for fp, a, b in zip(*(x.tolist() for x in self._places(k1, k2))):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == fp)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


def _filter_of(k1: np.ndarray, k2: np.ndarray, room: int = 0) -> CuckooFilter:
    room = max(len(k1), room)
    while not (out := CuckooFilter.sized(room)).add(k1, k2):
        room *= 2
    return out


@dataclass
class LineIndex:
    """Tables of the incremental line index (see the module text)."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, ASCII-lower-cased line, or None if shorter than ``min_chars`` code points."""
    key = line.strip(STRIPPED).lower()
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def _key_pair(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def line_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (k1, k2, doc_id) of every line key of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = column(batch, "doc_id").to_pylist(), []
            texts = column(batch, "text").cast(pa.binary())
            for doc_id, value in zip(ids, texts):
                text = value.as_py()
                if text is None or len(text) < min_chars:
                    continue
                keys = {k for k in (line_key(x, min_chars) for x in text.split(b"\n")) if k is not None}
                rows += [(*_key_pair(k), doc_id) for k in keys]
            if rows:
                k1, k2, doc = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(doc, pa.int64())], ["k1", "k2", "doc_id"]
                )

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pairs.mapInArrow(run, "k1 long, k2 long, doc_id long").distinct()


def _counts(postings: DataFrame, min_docs: int) -> DataFrame:
    per_key = postings.groupBy("k1", "k2").agg(F.count("doc_id").alias("refs"), F.max("doc_id").alias("last_doc"))
    return per_key.filter(F.col("refs") >= min_docs)


def _shard(n_shards: int):
    return F.pmod(F.col("k1"), F.lit(n_shards)).cast("int")


def _build_filters(counts: DataFrame, n_shards: int) -> DataFrame:
    def run(key, pdf):
        import pandas as pd

        made = _filter_of(pdf.k1.to_numpy(), pdf.k2.to_numpy(), SHARD_KEYS // 8)
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.dumps()]})

    keyed = counts.select(_shard(n_shards).alias("shard"), "k1", "k2")
    return keyed.groupBy("shard").applyInPandas(run, "shard int, buckets binary")


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """Index all lines of ``docs``."""
    postings = materialise(line_postings(docs, min_chars))
    counts = materialise(_counts(postings, min_docs))
    n_shards = max(1, -(-counts.count() // SHARD_KEYS))
    filters = materialise(_build_filters(counts, n_shards))
    return LineIndex(postings, counts, filters, n_shards, min_chars, min_docs)


def _recount(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """Count the touched keys again and move the keys that crossed ``min_docs``."""
    keys = touched.select("k1", "k2").distinct()
    fresh = materialise(_counts(postings.join(keys, ["k1", "k2"], "left_semi"), index.min_docs))
    stale = index.counts.join(keys, ["k1", "k2"], "left_semi")
    counts = materialise(index.counts.join(keys, ["k1", "k2"], "left_anti").unionByName(fresh))
    flips = (
        fresh.join(stale, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(1).alias("sign"))
        .unionByName(stale.join(fresh, ["k1", "k2"], "left_anti").select("k1", "k2", F.lit(-1).alias("sign")))
        .select(_shard(index.n_shards).alias("shard"), "k1", "k2", "sign")
    )

    def run(key, old, moved):
        import pandas as pd

        made = CuckooFilter.loads(old.buckets.iloc[0]) if len(old) else CuckooFilter.sized(len(moved))
        gone, new = moved[moved.sign < 0], moved[moved.sign > 0]
        made.remove(gone.k1.to_numpy(), gone.k2.to_numpy())
        if not made.add(new.k1.to_numpy(), new.k2.to_numpy()):
            return pd.DataFrame({"shard": [key[0]], "buckets": [None]})
        return pd.DataFrame({"shard": [key[0]], "buckets": [made.dumps()]})

    moved = index.filters.groupBy("shard").cogroup(flips.groupBy("shard")).applyInPandas(run, "shard int, buckets binary")
    moved = materialise(moved)
    if moved.filter(F.col("buckets").isNull()).limit(1).count():  # a full shard: size the filters anew
        n_shards = max(1, -(-counts.count() // SHARD_KEYS))
        return LineIndex(postings, counts, materialise(_build_filters(counts, n_shards)), n_shards, index.min_chars, index.min_docs)
    return LineIndex(postings, counts, moved, index.n_shards, index.min_chars, index.min_docs)


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Add the lines of new documents (a doc_id already present gains lines only)."""
    new = materialise(line_postings(docs, index.min_chars).join(index.postings, ["k1", "k2", "doc_id"], "left_anti"))
    return _recount(index, materialise(index.postings.unionByName(new)), new)


def delete_documents(index: LineIndex, ids: DataFrame) -> LineIndex:
    """Remove every posting of the documents in ``ids`` (column doc_id)."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    gone = materialise(index.postings.join(ids, "doc_id", "left_semi").select("k1", "k2", "doc_id"))
    left = materialise(index.postings.join(ids, "doc_id", "left_anti").select("k1", "k2", "doc_id"))
    return _recount(index, left, gone)


def _probe(index: LineIndex) -> DataFrame:
    """Postings whose key the filter of its shard may hold."""
    n_rows = index.postings.count()
    salts = max(1, -(-n_rows // (index.n_shards * PROBE_ROWS)))
    keys = index.postings.select(
        _shard(index.n_shards).alias("shard"),
        F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(None).cast("binary").alias("buckets"), "k1", "k2", "doc_id",
    )
    none = F.lit(None).cast("long")
    filters = index.filters.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "buckets",
        none.alias("k1"), none.alias("k2"), none.alias("doc_id"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, None
        for batch in batches:
            shard, salt = (np.asarray(column(batch, x)) for x in ("shard", "salt"))
            buckets = column(batch, "buckets")
            start = 0
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
            for stop in [*cuts.tolist(), len(shard)]:
                if start == stop:
                    continue
                if cell != (shard[start], salt[start]):
                    cell, held = (shard[start], salt[start]), None
                if buckets[start].is_valid:
                    held = CuckooFilter.loads(buckets[start].as_py())
                    start += 1
                if held is not None and start < stop:
                    part = batch.slice(start, stop - start)
                    hit = held.contains(np.array(column(part, "k1")), np.array(column(part, "k2")))
                    if hit.any():
                        yield part.select(["k1", "k2", "doc_id"]).filter(pa.array(hit))
                start = stop

    dealt = keys.unionByName(filters).repartition("shard", "salt")
    dealt = dealt.sortWithinPartitions("shard", "salt", F.col("buckets").isNull())
    return dealt.mapInArrow(run, "k1 long, k2 long, doc_id long")


def dropped_keys(index: LineIndex) -> DataFrame:
    """(doc_id, __drops): the line keys each document loses; filter hits checked exactly."""
    hits = _probe(index).join(index.counts, ["k1", "k2"])
    lost = hits.filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("last_doc")))
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("__drops"))


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, plus n_lines and n_dropped.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents stays only in the largest doc_id holding it.
    Other columns pass through; ``index`` is built from ``docs`` if not given.
    """
    index = index or build_index(docs, min_chars, min_docs)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    drops = dropped_keys(index)
    joined = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("text"))
    joined = joined.join(drops.withColumnRenamed("doc_id", "__drop_doc"), F.col("doc_id").eqNullSafe(F.col("__drop_doc")), "left").drop("__drop_doc")
    fields = [f for f in docs.schema.fields if f.name in rest]
    out_schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    least = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for value, drop in zip(column(batch, "text").cast(pa.binary()), column(batch, "__drops")):
                text = value.as_py() or b""
                if not drop.is_valid:
                    texts.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {(x["k1"], x["k2"]) for x in drop.as_py()}
                lines = text.split(b"\n")
                kept = [x for x in lines if (k := line_key(x, least)) is None or _key_pair(k) not in gone]
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            arrays = [column(batch, c) for c in rest]
            arrays += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, out_schema)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
