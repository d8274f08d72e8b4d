"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: maximal runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that are Python objects at once.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes (null stays null), so that workers never fail on malformed strings."""
    return F.col(column).cast("string").cast("binary")


def n_words(column: Column) -> Column:
    """JVM-side count of words; null counts as none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; a null id falls in fold of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores added to those that (in any case) are taken."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def over_rows(df: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply ``fn(*columns)`` (python lists in, tuple of lists out) to each Arrow batch.

    One batch is in memory at a time (Spark bounds it by rows and bytes) and ``SLICE`` of its rows as Python
    objects; nothing is shuffled, and a lost task only repeats its own partition.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(*(c.to_pylist() for c in batch.slice(at, SLICE).columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def each_text(text: Column, fn: Callable[[bytes | None], object], kind: pa.DataType) -> Column:
    """A column of ``fn(text as UTF-8 bytes)``. Only texts cross to Python, ``SLICE`` at a time as objects.

    Declared non-deterministic, though it isn't: otherwise a filter on the column, or a join key, is pushed below it
    and the function runs once more for each, with another worker in every task.
    """
    from pyspark.sql.pandas.types import from_arrow_type

    @F.arrow_udf(from_arrow_type(kind))
    def run(texts: pa.Array) -> pa.Array:
        parts = [
            pa.array([fn(t) for t in texts.slice(at, SLICE).to_pylist()], type=kind) for at in range(0, len(texts), SLICE)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run.asNondeterministic()(text.cast("string").cast("binary"))


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(sc._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without: one is made up for it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if base:
        # With its scheme: a bare path means a folder of the cluster's default file system.
        target, files = _hadoop_path(spark, base)
        return files.makeQualified(target).toString()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = f"file://{tempfile.mkdtemp(prefix='lexigrove-')}"
    return made


#: Folders made on the way to a settled table, by thread: runs in one driver don't see each other's.
_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own (as a URI) below the shared one. It is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target, files = _hadoop_path(spark, path)
    files.mkdirs(target.getParent())
    # Only a folder that exists can be marked.
    files.mkdirs(target)
    files.deleteOnExit(target)
    files.delete(target, True)
    made = _folders.get()
    if made is not None:
        made.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, written and read again, and its folder; the folders made on the way are removed."""
    made: list[str] = []
    before = _folders.set(made)
    try:
        done = saved(make(), label)
    finally:
        _folders.reset(before)
    *rest, path = made
    for other in rest:
        drop_folder(spark, other)
    if _folders.get() is not None:
        _folders.get().append(path)
    return done, path


def drop_folder(spark: SparkSession, path: str) -> None:
    target, files = _hadoop_path(spark, path)
    files.delete(target, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which otherwise stay until the driver happens to collect its garbage.

    Python's handles on them are given back to the JVM by a thread of their own, within a second or so.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1)
        spark.sparkContext._jvm.System.gc()


def local_path(uri: str) -> str:
    """The mounted path of a file: URI of the shared folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the shared folder must be mounted on every node to be memory-mapped: {uri}")
    return os.path.abspath(uri)
