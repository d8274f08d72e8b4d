"""Contracts of tables: required and optional columns, unique ids, no empty input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds absent columns as null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    found = duplicates(df, key).limit(5).collect()
    if found:
        raise ValueError(f"duplicate {key}: {[tuple(r)[:-1] for r in found]}")
    return df


def assert_some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
