"""The corpus pipeline: documents in, token ids out.

Each stage takes what its predecessor kept, reread from Parquet, and is one of
the operators of ``quirewise.llm``.

Rows: null and empty texts are scored like any other, and are one group of
copies, of which one row stays; a null ``doc_id`` comes last among copies and
stays where it is alone; ties between copies go to the smallest ``doc_id``, then
to the smallest hash of the whole row; repeated rows are copies; columns of any
name and kind, and in any case, are passed on as they are by all stages but the
last; empty tables give empty results, and without labels of both kinds every
document is kept by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewise.llm import bpe, mixing, quality, secrets, simhash
from quirewise.llm.common import read, run_folder

#: Tokens of the mixture, as a share of those of the documents that reach it.
MIX_SHARE = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the secret's kind."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.mix(docs, share=MIX_SHARE)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document: ``doc_id, ids, n_tokens``."""
    return bpe.encode(docs, bpe.default_path()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

#: The classifier, the fingerprints and the vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again.

    The stages' folders are in one new folder under the shared one; the last
    holds the result, so whoever reads that removes them.
    """
    docs = read(spark, sf_dir, "documents")
    folder = run_folder(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
