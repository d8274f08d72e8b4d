"""Tables in files: scans by suffix, optional tables, atomic and versioned writes, JSON lines, listings, uploads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip, year_hint
from ..operators.checks import duplicates, empty, require, with_optional
from . import records
from .scratch import saved


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, CSV or JSON lines by suffix; the required columns are checked."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet":
        df = reader.parquet(path)
    elif suffix == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif suffix in ("jsonl", "json"):
        df = reader.option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unsupported table: {path}")
    return require(df, columns or [])


def read_optional(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table that may be absent: then empty, with the columns; absent columns are null; others are left out."""
    if not _exists(spark, path):
        return empty(spark, ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    return with_optional(read_table(spark, path), columns).select(*columns)


def write_table(df: DataFrame, path: str) -> str:
    """Write whole, by suffix: to a folder aside that takes the old table's place at the end.

    The old table is kept aside until the new one has its place and is put back if that fails. Between the two renames
    readers find no table; one that must never miss it reads versions (see operators/index_store).
    """
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    suffix = path.rpartition(".")[2].lower()
    if suffix == "parquet":
        df.write.parquet(aside)
    elif suffix == "csv":
        df.write.option("header", True).option("escape", '"').csv(aside)
    elif suffix in ("jsonl", "json"):
        df.write.json(aside)
    else:
        raise ValueError(f"unsupported table: {path}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(path), hadoop.Path(aside)
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    before = hadoop.Path(f"{aside}.before")
    replaced = files.exists(old)
    if replaced and not files.rename(old, before):
        raise OSError(f"could not replace {path}")
    if not files.rename(new, old):
        if replaced:
            files.rename(before, old)
        raise OSError(f"could not write {path}")
    if replaced:
        files.delete(before, True)
    return path


def write_both(df: DataFrame, stem: str) -> list[str]:
    """Parquet and CSV of one table; the CSV is made from the Parquet, so the plan runs once."""
    first = write_table(df, f"{stem}.parquet")
    return [first, write_table(df.sparkSession.read.parquet(first), f"{stem}.csv")]


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def latest_success(log: DataFrame, key: str = "request_hash", order: str = "line") -> DataFrame:
    """The last successful record of each key in an append-only log."""
    ok = log.where("status = 'success'")
    rest = [c for c in ok.columns if c != key]
    best = ok.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def file_signature(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest, size) of each file: equal signatures mean equal inputs, wherever they lie (see sources/records)."""
    return records.signatures(spark, path)


def is_current(recorded: DataFrame, now: DataFrame) -> bool:
    """Whether an index's recorded signatures are those of today's inputs."""
    key = ["name", "digest", "size"]
    return recorded.select(*key).exceptAll(now.select(*key)).isEmpty() and now.select(*key).exceptAll(recorded.select(*key)).isEmpty()


def verify_checksum(spark: SparkSession, path: str, expected: str) -> str:
    found = records.plain_sha256(spark, path).first().sha256
    if found != expected.lower():
        raise ValueError(f"checksum mismatch for {path}: {found}")
    return found


# Reports and uploads -----------------------------------------------------------------------------------------


def reports(files: DataFrame, strict: bool = True) -> DataFrame:
    """From (file_name, file_path, file_size_bytes): reports named company_year_10k.pdf, with their parts and id."""
    pattern = r"^([a-z0-9]+)_(\d{4})_(10k)\.pdf$"
    parsed = files.withColumns(
        {
            "company": F.regexp_extract("file_name", pattern, 1),
            "fiscal_year": F.regexp_extract("file_name", pattern, 2).try_cast("int"),
            "document_type": F.regexp_extract("file_name", pattern, 3),
        }
    )
    if strict:
        bad = [r.file_name for r in parsed.where("company = ''").select("file_name").limit(5).collect()]
        if bad:
            raise ValueError(f"file names don't follow company_year_10k.pdf: {bad}")
    good = parsed.where("company <> ''").withColumn("doc_id", F.concat_ws("_", "company", F.col("fiscal_year").cast("string"), "document_type"))
    twice = [r.doc_id for r in duplicates(good, ["doc_id"]).limit(5).collect()]
    if twice:
        raise ValueError(f"duplicate documents: {twice}")
    return good


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Files of a folder as (file_name, file_path, file_size_bytes); contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    return reader.load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("file_path"), F.col("length").alias("file_size_bytes")
    )


def pages(files: DataFrame, parse: Callable[[bytes], list[str]], keys: list[str], most: int | None = None, skip_errors: bool = False) -> DataFrame:
    """One row for each page of each file (page_num from 1), by a parser run in Arrow batches."""
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    texts = parse(bytes(row["content"]))
                except Exception:
                    if not skip_errors:
                        raise
                    continue
                for i, text in enumerate(texts[:most], 1):
                    out.append([row[k] for k in keys] + [i, text])
            yield pd.DataFrame(out, columns=[*keys, "page_num", "raw_text"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "page_num int, raw_text string"])
    found = files.select(*keys, "content").mapInPandas(run, schema)
    words = F.regexp_count("raw_text", F.lit(r"[^\s\p{Z}]+")).cast("int")
    return found.withColumns({"char_count": F.length("raw_text"), "word_count": words})


def decoded(content: Column) -> Column:
    """Uploaded bytes as text: UTF-8 without its mark, else Latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def uploads(files: DataFrame) -> DataFrame:
    """From (file_name, content): metadata of uploaded documents; other kinds than pdf, txt and md raise."""
    stem = F.lower(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    name = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    name = F.when(name == "", "uploaded_document").otherwise(name)
    kind = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    bad = [r.file_name for r in files.where(~kind.isin("pdf", "txt", "md")).select("file_name").limit(5).collect()]
    if bad:
        raise ValueError(f"unsupported file types: {bad}")
    return files.withColumns(
        {
            "company": name,
            "doc_id": F.concat(F.lit("uploaded_"), name, F.lit("_"), F.substring(F.sha2("content", 256), 1, 10)),
            "fiscal_year": year_hint(F.col("file_name")),
            "document_type": kind,
            "document_source": F.lit("uploaded"),
        }
    )


def upload_pages(files: DataFrame) -> DataFrame:
    """Text uploads as documents of one page."""
    text = strip(decoded(F.col("content")))
    return uploads(files).select("doc_id", "company", "fiscal_year", "document_type", "file_name", F.lit(1).alias("page_num"), text.alias("raw_text"), "document_source")


def upload_summary(docs: DataFrame, paged: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, characters and chunks of each document; 0 where there are none."""
    p = paged.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.length("raw_text")).alias("char_count"))
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    out = docs.join(p, "doc_id", "left").join(c, "doc_id", "left")
    return out.na.fill(0, ["page_count", "char_count", "chunk_count"])


# Ordered results -----------------------------------------------------------------------------------------------


def write_sorted(df: DataFrame, path: str, order: list[Column | str]) -> str:
    """Write a table whose files, read in order of their names, are the rows in order: ranges are dealt to tasks and sorted there."""
    return write_table(df.orderBy(*order), path)


def numbered_in_order(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """Adds the place of each row in the order of all. No task holds more than a range: a row's number is its place in its range
    and the number of rows in the ranges before it. Rows alike in the order are numbered in any order."""
    ranged = saved(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range.
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = ranged.withColumn("__part", part).join(offsets, "__part")
    return out.select(*df.columns, (F.col("__before") + place + start).cast("long").alias(name))


def json_record(columns: list[str], df: DataFrame) -> Column:
    """Columns as a JSON object that has all of them; NaN and infinity are null, as nulls are."""
    kinds = dict(df.dtypes)
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c))
    return F.to_json(F.struct(*[(finite(c) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in columns]), {"ignoreNullFields": "false"})


def json_records(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(json_record(df.columns, df).alias(name))
