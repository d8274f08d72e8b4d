"""Keyed state of streams: what is newest of each key, and what is done. State lies in RocksDB under the query's checkpoint.

A batch reads and writes the state of its own keys, so its cost follows its rows and not the keys that were ever seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, StringType, StructField, StructType, TimestampNTZType, TimestampType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocks(spark: SparkSession) -> None:
    """State of several columns needs RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _milliseconds(ttl: str | None) -> int | None:
    return None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)


def _place(column: str, kind: DataType) -> Column:
    """A value that sorts like the column and that state can hold."""
    c = F.col(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(c)
    if isinstance(kind, BooleanType):
        return c.cast("int")
    if isinstance(kind, DecimalType):
        raise TypeError(f"cast {column} to a double or a string to order by it")
    return c


class _Newer(StatefulProcessor):
    """Passes a row on if it comes after all earlier ones of its key; its place is the state."""

    def __init__(self, places: int, kinds: StructType, columns: list[str], ttl: int | None):
        self.places, self.kinds, self.columns, self.ttl = places, kinds, columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("place", self.kinds, self.ttl) if self.ttl else handle.getValueState("place", self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best, found = (None if held is None else [_sortable(v) for v in held]), None
        for batch in rows:
            # By place: names that are no Python names arrive as others.
            for i, values in enumerate(zip(*(batch.iloc[:, len(self.columns) + p] for p in range(self.places)))):
                place = [_sortable(v) for v in values]
                if best is None or place > best:
                    best, found = place, batch.iloc[[i], : len(self.columns)]
        if found is not None:
            self.last.update(tuple(v for _, v in best))
            yield found.set_axis(self.columns, axis=1).reset_index(drop=True)

    def close(self) -> None:
        pass


def _sortable(value) -> tuple:
    """Null first."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return (False, None)
    return (True, value.item() if hasattr(value, "item") else value)


def newer(stream: DataFrame, key: list[str], order: list[str], ttl: str | None = None) -> DataFrame:
    """Rows that become the last of their key by ``order``; of rows alike in it the first stays."""
    _rocks(stream.sparkSession)
    places = {f"__place{i}": _place(c, stream.schema[c].dataType) for i, c in enumerate(order)}
    marked = stream.withColumns(places)
    kinds = StructType([StructField(f"p{i}", marked.schema[p].dataType) for i, p in enumerate(places)])
    processor = _Newer(len(places), kinds, stream.columns, _milliseconds(ttl))
    return marked.groupBy(*key).transformWithStateInPandas(processor, stream.schema, "Update", "ProcessingTime" if ttl else "None")


class _Worked(StatefulProcessor):
    """Runs a function on the rows of a key that isn't done yet."""

    def __init__(self, key: str, columns: list[str], work: Callable[[pd.DataFrame], tuple[str, int, str]], ttl: int | None):
        self.key, self.columns, self.work, self.ttl = key, columns, work, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = StructType([StructField("status", StringType())])
        self.done = handle.getValueState("done", kind, self.ttl) if self.ttl else handle.getValueState("done", kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        try:
            status, count, message = self.work(pd.concat(list(rows), ignore_index=True).set_axis(self.columns, axis=1))
        except Exception as error:
            status, count, message = "error", 0, str(error)
        if status == "success":
            self.done.update((status,))
        yield pd.DataFrame({self.key: [key[0]], "status": [status], "record_count": [count], "error_message": [message]})

    def close(self) -> None:
        pass


def worked(stream: DataFrame, key: str, work: Callable[[pd.DataFrame], tuple[str, int, str]], ttl: str | None = None) -> DataFrame:
    """(key, status, record_count, error_message) of each key that was worked on in a batch."""
    _rocks(stream.sparkSession)
    schema = f"`{key}` {dict(stream.dtypes)[key]}, status string, record_count int, error_message string"
    return stream.groupBy(key).transformWithStateInPandas(_Worked(key, stream.columns, work, _milliseconds(ttl)), schema, "Update", "ProcessingTime" if ttl else "None")
