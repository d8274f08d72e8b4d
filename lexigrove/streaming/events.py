"""Structured Streaming: keyed state, resumable extraction and windowed counts, with their batch equivalents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import keep_last
from ..sources.versions import Versions
from . import state


def tumbling(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums by type in windows of event time; ``late`` sets a watermark on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, in batch form."""
    return keep_last(rows, key, order)


def read_latest(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The table that :func:`keep_latest` keeps: the last row of each key among its changes."""
    return keep_last(Versions(spark, path).read(), key, order)


def compact_latest(spark: SparkSession, path: str, key: list[str], order: list[str]) -> None:
    """Leave one change of each key."""
    Versions(spark, path).compact(lambda changes: keep_last(changes, key, order))


def keep_latest(stream: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str, ttl: str | None = None):
    """Keeps a table of the last row of each key up to date from a stream; a batch that comes again changes nothing.

    The state of a key is its place in the order. A batch writes the rows that took their key's place, and no others; see
    :func:`read_latest`. A key that isn't seen for ``ttl`` is forgotten: a late row of it is then a change again, which
    reading puts right.
    """
    changes = state.newer(stream, key, order, ttl)

    def write(batch: DataFrame, number: int) -> None:
        Versions(batch.sparkSession, path).append(batch.select(*stream.columns), (checkpoint, number))

    return _started(changes, write, checkpoint)


def process_pending(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "chunk_id"):
    """Runs ``work`` on the rows of each micro-batch that have no successful record yet, and appends its records.

    ``work`` returns (key, status, record_count, error_message); success without records counts, errors come again. A batch
    reads the keys that are done and writes its own records; see :func:`records`.
    """
    columns = [key, "status", "record_count", "error_message"]

    def step(batch: DataFrame, number: int) -> None:
        log = Versions(batch.sparkSession, path)
        if log.current()[1].get("parts"):
            batch = batch.join(log.read().where("status = 'success'").select(key), key, "left_anti")
        log.append(work(batch).select(*columns), (checkpoint, number))

    return _started(stream, step, checkpoint, "append")


def process_keys(
    stream: DataFrame, work: Callable[[pd.DataFrame], tuple[str, int, str]], path: str, checkpoint: str, key: str = "chunk_id", ttl: str | None = None
):
    """Runs ``work`` in the workers, once on each key's first rows, and appends (key, status, record_count, error_message).

    What is done is state, so a batch neither reads nor writes more than its own rows. Keys that failed come again with their next rows; a raised
    exception is an error with its message. ``ttl`` forgets what was done so long ago.
    """
    done = state.worked(stream, key, work, ttl)
    return _started(done, lambda batch, number: Versions(batch.sparkSession, path).append(batch, (checkpoint, number)), checkpoint)


def records(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """A record of each key: a successful one if there is any."""
    return keep_last(Versions(spark, path).read(), [key], [F.col("status") == "success", F.xxhash64("status", "record_count", "error_message")])


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
