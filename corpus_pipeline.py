"""A corpus pipeline: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the documents of the next.  All but the last
return the columns of the documents, whatever else and by whatever name stands
among them.  Null and empty texts are judged like others, rows that repeat a
doc_id with its text leave one row, rows of one doc_id with different texts are
judged apart, rows without a doc_id are never near-duplicates, an empty table
gives an empty result, and without labels nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from ledgerlight.llm import packing, quality, secrets, simhash
from ledgerlight.llm.common import staged, table
from ledgerlight.llm.queries import vocabulary
from pyspark.sql import DataFrame, SparkSession


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among the documents given."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in the texts give way to a mark; no document goes."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' tokens in sequences of 1024."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier's training and the fingerprints' votes are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
