"""Operators for preparing training data, and the queries that apply them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, licenses, media, mixing, negatives, quality, secrets, simhash, structure, substrings, tokens, vectors

_QUERIES = (
    mixing.op1_mixing,
    chat.op2_chat,
    simhash.op3_simhash,
    media.op4_media,
    licenses.op5_licenses,
    tokens.op6_tokens,
    secrets.op7_secrets,
    vectors.op8_vectors,
    quality.op9_quality,
    bpe.op10_bpe,
    negatives.op11_negatives,
    substrings.op12_superkmers,
    structure.op13_structure,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries by name."""
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op1_mixing": mixing.ORACLE, "op11_negatives": negatives.ORACLE, "op12_superkmers": substrings.ORACLE}
