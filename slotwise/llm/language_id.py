"""Language ID with language-bitmask n-gram filters.

Training counts byte 3- and 4-grams of lower-cased letters per language over a
bounded sample of labelled documents (``sample_docs`` per language, a
parameter), keeps the most frequent ``grams`` that are at home in the language,
and sets one bit per language in a shared bit-sliced Bloom filter: entry ``i``
is a bitmask of all languages, so one probe returns every language that
contains the n-gram.  A text's n-grams are probed, the bits are counted per
language, the counts are corrected for each language's false-positive rate
(fill ** hashes), and the largest corrected count decides.

Tables: the sample is chosen by a hash of the id, counts are aggregated by
Spark, and what reaches the driver is at most ``grams`` rows per language.
Prediction is a narrow map over whole texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
a text none of whose n-grams is known gets the most frequent language with
score 0; ties go to the language with more documents, then by name; without
any labelled document every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.common import column, large_text, mix64, read_table, text_buffers, text_chunks

#: Bound on the documents of one language that the filters are learned from (expected size of a hash sample).
SAMPLE_DOCS = 3000
#: Bound on the n-grams a language keeps.
GRAMS = 30_000
#: An n-gram is at home in a language at this share or more of its highest relative frequency.
HOME_SHARE = 0.1
HASHES = 3
UNKNOWN = "und"
_SPACE = 0x20


def _letter_table() -> np.ndarray:
    """Byte -> byte: lower-case ASCII letters and bytes of longer characters stay, others become a space."""
    table = np.full(256, _SPACE, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_TABLE = _letter_table()


def gram_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text index) of all byte 3- and 4-grams of null-free large_string texts.

    A text is read as if between two spaces; n-grams with two spaces in a row
    are left out.  The code is the bytes themselves, so it is exact.
    """
    gap = pa.scalar(" ", pa.large_string())
    padded = pc.binary_join_element_wise(gap, pc.utf8_lower(texts), gap, pa.scalar("", pa.large_string()))
    data, offsets = text_buffers(padded)
    d = _TABLE[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    double = (d[:-1] == _SPACE) & (d[1:] == _SPACE)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    tri = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
    good = ~(double[:-1] | double[1:]) & (owner[:-2] == owner[2:])
    codes, owners = [tri[good]], [owner[:-2][good]]
    if len(d) >= 4:
        quad = tri[:-1] | (d[3:] << np.uint32(24))
        good4 = good[:-1] & ~double[2:] & (owner[:-3] == owner[3:])
        codes.append(quad[good4])
        owners.append(owner[:-3][good4])
    return np.concatenate(codes), np.concatenate(owners)


@dataclass
class LanguageFilters:
    """Bit-sliced Bloom filter; ``languages`` are in order of falling document count."""

    languages: list[str]
    words: list[np.ndarray]  # one array of bitmasks per 64 languages
    bits: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: list[np.ndarray]) -> LanguageFilters:
        """``grams[i]``: the codes of ``languages[i]``."""
        largest = max((len(g) for g in grams), default=1)
        bits = max(10, int(np.ceil(np.log2(10 * max(largest, 1)))))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        words = [np.zeros(1 << bits, kind) for _ in range(-(-len(languages) // 64) or 1)]
        for i, codes in enumerate(grams):
            word, bit = words[i // 64], kind(1 << (i % 64))
            for place in _places(codes, bits):
                word[place] |= bit
        fill = np.array([((words[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, words, bits, fill**HASHES)

    def counts(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, corrected counts per text and language)."""
        total = np.bincount(owner, minlength=n).astype(float)
        out = np.zeros((n, len(self.languages)))
        for w, word in enumerate(self.words):
            hit = None
            for place in _places(codes, self.bits):
                hit = word[place] if hit is None else hit & word[place]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                has = (hit >> word.dtype.type(i % 64)) & word.dtype.type(1)
                out[:, i] = np.bincount(owner, weights=has, minlength=n)
        rate = self.false_rate[None, :]
        return total, np.clip((out - total[:, None] * rate) / (1 - rate), 0, None)


def _places(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter positions of every code, one array per hash (double hashing)."""
    h = mix64(codes.astype(np.uint64))
    a, b, mask = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64((1 << bits) - 1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) & mask).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS) -> LanguageFilters:
    """Learn the filters from the rows of ``docs`` (doc_id, text, lang) with a non-null lang."""
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = sorted(((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    languages = [x for x, _ in sizes]
    if not languages:
        return LanguageFilters.build([], [])
    rate = F.create_map(*[F.lit(v) for lang, n in sizes for v in (lang, min(1.0, sample_docs / n))])
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = known.filter(share < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = column(batch, "lang").to_numpy(zero_copy_only=False), large_text(column(batch, "text"))
            for lang in sorted(set(langs)):
                own = texts.filter(pa.array(langs == lang))
                for start, stop in text_chunks(own):
                    codes, n = np.unique(gram_codes(own.slice(start, stop - start))[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"]
                    )

    per_gram = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rates = per_gram.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    home = rates.withColumn("top", F.max("rate").over(Window.partitionBy("code"))).filter((F.col("n") > 1) & (F.col("rate") >= HOME_SHARE * F.col("top")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    rows = home.withColumn("rank", rank).filter(F.col("rank") <= grams).select("lang", "code").toPandas()
    by = {lang: part.code.to_numpy().astype(np.uint32) for lang, part in rows.groupby("lang")}
    return LanguageFilters.build(languages, [by.get(x, np.zeros(0, np.uint32)) for x in languages])


def predict_texts(filters: LanguageFilters, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a string array (nulls allowed)."""
    texts = large_text(texts)
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    lettered = np.array(pc.match_substring_regex(texts, r"\pL")) if len(texts) else np.zeros(0, bool)
    for start, stop in text_chunks(texts):
        if not filters.languages:
            break
        codes, owner = gram_codes(texts.slice(start, stop - start))
        _, found = filters.counts(codes, owner, stop - start)
        best, total = found.argmax(axis=1), found.sum(axis=1)
        top = found[np.arange(len(best)), best]
        names[start:stop] = np.array(filters.languages, object)[best]
        scores[start:stop] = np.where(total > 0, top / np.maximum(total, 1e-12), 0.0)
    return np.where(lettered, names, UNKNOWN).tolist(), np.where(lettered, scores, 0.0)


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only ``text`` decides."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict_texts(filters, column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
