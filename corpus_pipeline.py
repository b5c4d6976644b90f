"""The corpus pipeline: quality rules, near-duplicate removal, mixing, and BPE encoding with decoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bagminhash, bpe_stream, fertility, mixing
from sparkloom.llm.common import read
from sparkloom.session import materialise, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser-fertility rules keep."""
    ship(spark)
    return fertility.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    ship(spark)
    return bagminhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which the sources follow their target weights."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with the digests of the ids and of the decoded text."""
    ship(spark)
    return bpe_stream.round_trip(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixed", mixed), ("encoded", encoded)]

#: The rules need a tokeniser, near-duplicates signatures and encoding merges: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
