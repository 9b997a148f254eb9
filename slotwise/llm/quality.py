"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut its score into grades: P(grade <= j) = sigmoid(theta_j - w.x).
Scoring gives the expected grade and the tail probability of the top grade,
which selects documents.

Grades of the driver's ratings: 0 low quality, 1 good but toxic, 2 good and
not toxic.  The model is fitted on a bounded sample of labelled documents
(``sample_rows``, a parameter; the rows with the smallest id hashes), whose
hashed features are all that reaches the driver.  Scoring is a narrow map over
whole texts.

Features, hashed into ``DIMENSIONS`` weights: each distinct lower-cased word, word
start and symbol run of the text (presence), and levels of four shares (symbols, words
equal to the word before, upper case, length).

Defined cases: null and empty texts have no words and are scored by their
levels; rows with null ratings are not used; of several ratings of a document
the lowest counts; with no ratings every document gets the top grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import column, discard, large_text, materialise, read_table, span_hashes, text_buffers, text_chunks, word_spans

DIMENSIONS = 1 << 18
#: Bound on the labelled documents that the model is fitted on.
SAMPLE_ROWS = 16_000
#: Features of fewer sampled documents get no weight.
MIN_DOCS = 4
#: Features get a weight if their presence correlates with any one grade by this many standard errors; there is no
#: floor on the correlation itself, which a rare word cannot reach however pure it is.
LEAST_CORRELATION = 0.0
LEAST_Z = 4.0
#: Strength of the L2 term, as a sum over the sampled rows.
L2_ROWS = 0.5
#: A document is kept from this tail probability of the top grade on.
KEEP_FROM = 0.7
GRADES = 3
#: The first bytes of a word are a feature of their own, shared by its inflections.
STEM_BYTES = 5


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in (("a", "z"), ("A", "Z"), ("0", "9")):
        table[ord(lo) : ord(hi) + 1] = True
    table[0x80:] = True
    return table


_WORD = _word_table()
_SYMBOL = ~_WORD & (np.arange(256) > 0x20)


def _levels(share: np.ndarray, steps: int = 20) -> np.ndarray:
    return np.minimum((share * steps).astype(np.int64), steps - 1)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs, distinct and sorted, of null-free large_string texts."""
    raw, raw_offs = text_buffers(texts)
    n = len(texts)
    upper = np.bincount(np.repeat(np.arange(n), np.diff(raw_offs)), weights=(raw >= 65) & (raw <= 90), minlength=n) if len(raw) else np.zeros(n)
    data, offsets = text_buffers(pc.utf8_lower(texts))
    starts, ends, owner = word_spans(data, offsets, _WORD)
    words = span_hashes(data, starts, ends)
    stems = span_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES)) ^ np.uint64(0x3333333333333333)
    s_starts, s_ends, s_owner = word_spans(data, offsets, _SYMBOL)
    symbols = span_hashes(data, s_starts, s_ends) ^ np.uint64(0x5555555555555555)
    n_words, n_symbols = np.bincount(owner, minlength=n), np.bincount(s_owner, minlength=n)
    again = np.zeros(len(words))
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, weights=again, minlength=n)
    size = np.maximum(np.diff(raw_offs), 1)
    stats = np.stack([
        _levels(n_symbols / np.maximum(n_words + n_symbols, 1)),
        _levels(repeats / np.maximum(n_words, 1)),
        _levels(upper / size),
        np.minimum(np.log2(size).astype(np.int64), 19),
    ])
    room = DIMENSIONS - stats.shape[0] * 20
    ids = [(words % np.uint64(room)).astype(np.int64), (symbols % np.uint64(room)).astype(np.int64), (stems % np.uint64(room)).astype(np.int64)]
    owners = [owner, s_owner, owner]
    for k, level in enumerate(stats):
        ids.append(room + 20 * k + level)
        owners.append(np.arange(n))
    keys = np.unique(np.concatenate(owners).astype(np.int64) * DIMENSIONS + np.concatenate(ids))
    return keys // DIMENSIONS, keys % DIMENSIONS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for every text (rows) and threshold j (columns)."""
        return 1.0 - _sigmoid(self.thresholds[None, :] - scores[:, None])

    def score_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, tail probability of the top grade) of a string array."""
        texts = large_text(texts)
        scores = np.zeros(len(texts))
        for start, stop in text_chunks(texts):
            owner, ids = features(texts.slice(start, stop - start))
            scores[start:stop] = np.bincount(owner, weights=self.weights[ids], minlength=stop - start)
        tail = self.tail(scores)
        return tail.sum(axis=1), tail[:, -1]


def active_features(by_grade: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Features that get a weight, from their documents per grade (rows) and all documents per grade."""
    n = int(documents.sum())
    counts = by_grade.sum(axis=0)
    error = np.sqrt(np.maximum(counts * (1 - counts / max(n, 1)), 1e-9))
    gap = np.zeros(by_grade.shape[1])
    for hits, docs in zip(by_grade, documents):  # each grade by itself: a middle grade hardly moves the mean
        share = docs / max(n, 1)
        gap = np.maximum(gap, np.abs(hits - counts * share) / (max(np.sqrt(share * (1 - share)), 1e-9) * error))
    return np.flatnonzero((counts >= MIN_DOCS) & (counts < n) & (gap >= max(LEAST_Z, LEAST_CORRELATION * np.sqrt(n))))


def fit_ordinal(
    rows: np.ndarray, ids: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, dimensions: int = DIMENSIONS, l2: float = 1e-6, steps: int = 600, rate: float = 0.1
) -> OrdinalModel:
    """Fit by Adam on the mean log-likelihood; (rows, ids) are the features present.

    Thresholds are kept in order as a first value plus exponentials.
    """
    n = len(grades)
    by_grade = np.stack([np.bincount(ids[grades[rows] == grade], minlength=dimensions) for grade in range(n_grades)])
    active = active_features(by_grade, np.bincount(grades, minlength=n_grades))
    index = np.full(dimensions, -1)
    index[active] = np.arange(len(active))
    keep = index[ids] >= 0
    rows, cols = rows[keep], index[ids[keep]]
    share = np.array([(grades <= j).mean() for j in range(n_grades - 1)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    theta = np.concatenate([[start[0]], gaps, np.zeros(len(active))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    edges = n_grades - 1
    for t in range(1, steps + 1):
        cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:edges]))])
        w = theta[edges:]
        score = np.bincount(rows, weights=w[cols], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        at = np.arange(n)
        hi, lo = below[at, grades + 1], below[at, grades]
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        p = np.maximum(hi - lo, 1e-9)
        g_score = (d_hi - d_lo) / p / n  # gradient of the negative log-likelihood
        g_cut = np.zeros(edges + 2)
        np.add.at(g_cut, grades + 1, -d_hi / p / n)
        np.add.at(g_cut, grades, d_lo / p / n)
        g_cut = g_cut[1:-1]
        grad = np.concatenate([[g_cut.sum()], [np.exp(theta[k]) * g_cut[k:].sum() for k in range(1, edges)], np.bincount(cols, weights=g_score[rows], minlength=len(active)) + l2 * w])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(dimensions)
    weights[active] = theta[edges:]
    return OrdinalModel(weights, np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:edges]))]))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 good but toxic, 2 good and not toxic."""
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rows of ``grades`` (doc_id, grade), joined with their texts."""
    sample = grades.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_rows)
    pairs = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large_text(column(batch, "text"))
            for start, stop in text_chunks(texts):
                owner, ids = features(texts.slice(start, stop - start))
                parts = np.split(ids.astype(np.int32), np.searchsorted(owner, np.arange(1, stop - start)))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "grade"), pa.array(parts, pa.list_(pa.int32()))], ["doc_id", "grade", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialise(pairs.mapInArrow(run, f"doc_id {kind}, grade int, ids array<int>"))
    documents = np.zeros(GRADES, np.int64)
    for r in found.groupBy("grade").count().collect():
        documents[r["grade"]] = r["count"]
    if not documents.sum():
        discard(found)
        return OrdinalModel(np.zeros(DIMENSIONS), np.full(GRADES - 1, -10.0))
    # documents per feature and grade are counted in Spark; of the lists only the features with a weight reach the driver
    by_grade = np.zeros((GRADES, DIMENSIONS), np.int64)
    sums = [F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)]
    counted = found.select("grade", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *sums)
    counted = counted.filter(F.col("n") >= MIN_DOCS).toArrow()
    for g in range(GRADES):
        by_grade[g, counted.column("id").to_numpy()] = counted.column(f"g{g}").to_numpy()
    del counted
    wanted = np.zeros(DIMENSIONS, bool)
    wanted[active_features(by_grade, documents)] = True
    del by_grade

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "ids")
            flat = np.asarray(ids.flatten())
            ends = np.concatenate([[0], np.cumsum(wanted[flat])])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))])]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[wanted[flat]], pa.int32()))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "grade"), lists], ["doc_id", "grade", "ids"])

    table = found.mapInArrow(narrow, f"doc_id {kind}, grade int, ids array<int>").toArrow().sort_by("doc_id").combine_chunks()
    discard(found)
    lists = table.column("ids").combine_chunks()
    size = len(lists)
    rows, ids = np.repeat(np.arange(size), np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())
    grades = np.asarray(table.column("grade").combine_chunks()).astype(np.int64)
    del table, lists
    return fit_ordinal(rows, ids, grades, l2=L2_ROWS / size)


def score(docs: DataFrame, model: OrdinalModel, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """``docs`` with expected grade and tail probability as ``names`` (columns of these names are replaced)."""
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = model.score_texts(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], [*rest, *names])

    return kept.mapInArrow(run, schema)


def select(docs: DataFrame, model: OrdinalModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose tail probability reaches ``keep_from``, columns as in ``docs``."""
    return score(docs, model, ("__grade", "__tail")).filter(F.col("__tail") >= keep_from).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(read_table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= KEEP_FROM).alias("kept"))
