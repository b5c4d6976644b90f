"""The registry of queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import engine_queries, evaluation_queries, question_queries, retrieval_queries, section_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (text_queries, section_queries, retrieval_queries, question_queries, evaluation_queries, engine_queries)


def queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
