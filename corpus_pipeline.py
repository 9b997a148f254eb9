"""Corpus pipeline over ``documents``: filter, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents`` (``n_chars`` follows
the text).  ``run`` writes every stage to the shared folder and reads it back.

``ORACLE_SQL`` is None: the quality model and the piece lattice have no SQL.  The
stages are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm import decontaminate, line_dedup, ngram_join, quality, sentencepiece_nbest
from slotwise.llm.common import materialise, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the top grade is high enough."""
    model = quality.train(docs, quality.graded(read_table(spark, sf_dir, "labels")))
    return quality.select(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that other documents keep."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest doc_id, of each group of near duplicates.

    Rows are told apart by a number written with them, not by doc_id: ids that repeat or
    are null lose no text, and repeated rows are a group like any other.
    """
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()))
    classes = ngram_join.jaccard_join(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "class_id")
    firsts = classes.join(rows.select("__row", "doc_id"), "__row").groupBy("class_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    return rows.join(firsts.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the piece ids of every document."""
    return sentencepiece_nbest.encode(docs).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "n_best", "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_per_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("SentencePiece encoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
