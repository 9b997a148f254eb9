"""Registered queries of the subpackage: ``opN_*`` and their DuckDB SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotwise.llm import bpe, collocations, decontaminate, fingerprint, html_extract, language_id, line_dedup, ngram_join, pii, quality, sentencepiece_nbest, tool_calls, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_sentencepiece_nbest": sentencepiece_nbest.op4_sentencepiece_nbest,
    "op5_language_id": language_id.op5_language_id,
    "op6_pii_surrogates": pii.op6_pii_surrogates,
    "op7_tool_calls": tool_calls.op7_tool_calls,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_collocations": collocations.op11_collocations,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_bpe": bpe.op13_bpe,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op7_tool_calls": tool_calls.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
