"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import retrieval_queries, table_queries, text_queries

_PARTS = (text_queries, table_queries, retrieval_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged hybrid retrieval end to end."""
    return retrieval_queries.top3(spark, sf_dir)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
