"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session may do without: one is made up for it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(shared_folder, "made", None)
    if made is None:
        made = shared_folder.made = f"file://{tempfile.mkdtemp(prefix='lexigrove-')}"
    return made


def remove_at_end(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Written as Parquet and read again: lineage is cut, and a plan that is used twice runs once. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
