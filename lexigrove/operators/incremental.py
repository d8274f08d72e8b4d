"""Keyed state kept up to date: hashes, missing rows, keep-first and keep-last, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cleaned, content_hash


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key: the first in ``order``.

    An aggregate, not a window: tasks keep one row a key before the shuffle, so a hot key costs nothing.
    """
    place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), place).alias("__row")) if rest else df.select(*key).distinct()
    return best.select(*[c if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns]) if rest else best


def keep_last(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key: the last in ``order``."""
    place = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("__row")) if rest else df.select(*key).distinct()
    return best.select(*[c if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns]) if rest else best


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str = "ordinal") -> DataFrame:
    """Existing rows with those of the same key replaced; of new rows of one key, the last by ``order``."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, ["__new", order]).drop("__new")


def with_hash(df: DataFrame, text_col: str, hash_col: str = "text_hash") -> DataFrame:
    """A blank or absent hash is computed from the text."""
    made = content_hash(F.col(text_col))
    if hash_col not in df.columns:
        return df.withColumn(hash_col, made)
    return df.withColumn(hash_col, F.when(cleaned(F.col(hash_col)) == "", made).otherwise(F.col(hash_col)))


def missing_rows(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't cached yet."""
    return wanted.join(cache.select(*key).distinct(), key, "left_anti")


def pending(chunks: DataFrame, output: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Chunks without output and without a successful checkpoint; errors come again."""
    done = output.select("chunk_id").union(checkpoint.where("status = 'success'").select("chunk_id"))
    return chunks.join(done.where("chunk_id IS NOT NULL").distinct(), "chunk_id", "left_anti")


def checkpoint_from_output(output: DataFrame) -> DataFrame:
    counts = output.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.count("*").cast("int").alias("record_count"))
    return counts.select("chunk_id", F.lit("success").alias("status"), "record_count", F.lit("").alias("error_message"))


def bootstrap(checkpoint: DataFrame, output: DataFrame) -> DataFrame:
    """Rows made from the output override the checkpoint's."""
    return union_keep_last(checkpoint, checkpoint_from_output(output), ["chunk_id"])


def union_keep_last(base: DataFrame, added: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Both tables with columns missing on a side as null; on equal keys the added row stays.

    Of several rows of a key on one side the last by ``order`` stays (by default the column ordinal, where there is
    one); rows alike in that are decided by a hash of their other columns, so that reruns agree. The result has no column ordinal.
    """
    both = base.withColumn("__new", F.lit(0)).unionByName(added.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = order if order is not None else [c for c in ("ordinal",) if c in both.columns]
    rest = [c for c in both.columns if c not in (*key, *order, "__new")]
    tie = [F.xxhash64(*rest)] if rest else []
    return keep_last(both, key, ["__new", *order, *tie]).drop("__new", "ordinal")


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 1, by: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)) + (start - 1))
