"""JSON lines with line numbers, and signatures of files of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF = 4 << 20  # bytes of a file that are hashed as one
FANOUT = 1024  # hashes that are hashed together
LEVELS = 3  # LEAF * FANOUT ** LEVELS bytes is the largest file
WHOLE = 256 << 20  # files up to this size are read as one value


# JSON lines ----------------------------------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files; lines count from 1 in each file, blank ones too.

    Files are read in splits, in parallel. The ids that Spark gives to rows are consecutive in a split, so a line's number
    is its distance from the first of its split and the number of lines in the file's splits before: one count, no sort of lines.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("text"),
    )
    splits = read.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # One row a split.
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    joined = read.join(splits, ["file", "block"])
    return joined.select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Adds record and bad. A line must be one JSON object that fits the schema; from_json alone ignores what follows an object."""
    record = F.from_json("text", f"{schema}, `__bad` string", {"columnNameOfCorruptRecord": "__bad"})
    parts = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")
    alone = F.coalesce((F.size(parts) == 1) & parts[0].isNotNull(), F.lit(False))
    full = lines.where(F.trim(F.regexp_replace("text", r"\s", " ")) != "").withColumn("record", record)
    return full.withColumn("bad", ~alone | F.col("record.__bad").isNotNull())


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of all lines that aren't a record: not JSON, no object, several on a line, or of another type."""
    return _parsed(numbered_lines(spark, path), schema).where("bad").select("file", "line", "text")


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines with their file and line. Blank lines are skipped; input without a record is an error.

    A bad line stops the query with its file and number, even if no column of it is used; unless ``strict``, bad lines are
    left out (``bad_lines`` has them).
    """
    parsed = _parsed(numbered_lines(spark, path), schema)
    if parsed.select("text").isEmpty():
        raise ValueError(f"no records in {path}")
    if strict:
        fault = F.raise_error(F.format_string("line %d of %s is no record: %s", "line", "file", F.substring("text", 1, 200)))
        kept = parsed.where(F.when(F.col("bad"), fault.cast("boolean")).otherwise(True))
    else:
        kept = parsed.where("NOT bad")
    names = [c for c in kept.select("record.*").columns if c != "__bad"]
    return kept.select(*[F.col(f"record.`{c}`").alias(c) for c in names], "file", "line")


# Signatures ----------------------------------------------------------------------------------------------------


def _local(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _hashed_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaves of ranges (path, from_leaf, to_leaf), read one leaf at a time."""
    from pyarrow.fs import FileSystem

    for batch in batches:
        for path, low, high in zip(batch["path"], batch["from_leaf"], batch["to_leaf"]):
            system, inner = FileSystem.from_uri(_local(path))
            with system.open_input_file(inner) as file:
                file.seek(low * LEAF)
                hashes = [hashlib.sha256(file.read(LEAF)).hexdigest() for _ in range(low, high)]
            yield pd.DataFrame({"path": path, "at": range(low, high), "hash": hashes})


def _leaves(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / LEAF)).cast("long")


def signatures(spark: SparkSession, root: str, glob: str | None = None, whole: int = WHOLE, leaves: int = 256) -> DataFrame:
    """(name, digest, size) of the files of a folder, or of one file: equal signatures mean equal inputs, wherever they lie.

    ``name`` is the path relative to the folder (the file's name if ``root`` is a file). ``digest`` is a tree of SHA-256: leaves of 4 MiB, then
    hashes of 1024 hashes at a time, so no task holds more and it doesn't depend on how files are read. Files up to ``whole`` bytes are read
    by Spark; larger ones in ranges of ``leaves`` leaves, each range in a task, through Arrow's file systems.
    Files without a byte have no row, as Spark's scans leave them out.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = system.makeQualified(path).toString().rstrip("/")
    base = full if system.getFileStatus(path).isDirectory() else full.rpartition("/")[0]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader if glob is None else reader.option("pathGlobFilter", glob)).load(root)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), _leaves(F.col("length")) - 1), lambda i: F.sha2(F.substring("content", (i * LEAF + 1).cast("int"), F.lit(LEAF)), 256))
    small = files.where(F.col("length") <= whole).select("path", F.posexplode(cut).alias("at", "hash"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), _leaves(F.col("length")) - 1, F.lit(leaves).cast("long")))
    ranges = files.where(F.col("length") > whole).select("path", "length", starts.alias("from_leaf"))
    ranges = ranges.select("path", "from_leaf", F.least(F.col("from_leaf") + leaves, _leaves(F.col("length"))).alias("to_leaf"))
    dealt = ranges.repartition("path", "from_leaf")
    level = small.select("path", F.col("at").cast("long").alias("at"), "hash").union(dealt.mapInPandas(_hashed_ranges, "path string, at long, hash string"))
    for _ in range(LEVELS):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy("path", F.floor(F.col("at") / FANOUT).alias("up")).agg(F.sha2(joined.cast("binary"), 256).alias("hash")).withColumnRenamed("up", "at")
    sizes = files.select("path", F.col("length").alias("size"))
    # Paths are compared without their scheme's empty host: file:/a and file:///a are one.
    plain = lambda p: F.regexp_replace(p, "^([a-z0-9]+:)/*", "$1/")
    prefix = F.length(plain(F.lit(base)))
    name = F.substring(plain(F.col("path")), prefix + 2, F.length("path"))
    return level.join(sizes, "path").select(name.alias("name"), F.col("hash").alias("digest"), "size")


def plain_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files as a published checksum has it. It has to be computed in order, so a file is read by one task, in pieces of 4 MiB."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for one in batch["path"]:
                system, inner = FileSystem.from_uri(_local(one))
                state = hashlib.sha256()
                with system.open_input_stream(inner) as file:
                    while piece := file.read(LEAF):
                        state.update(piece)
                yield pd.DataFrame({"path": [one], "sha256": [state.hexdigest()]})

    return files.mapInPandas(run, "path string, sha256 string")
