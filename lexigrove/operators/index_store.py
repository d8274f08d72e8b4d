"""Persistent retrieval index: a Parquet table and a manifest that says what it was built from.

The manifest is written last, so a folder without one is no index; it is current while the signatures of its inputs are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .retrieval import index

FORMAT = 2
BACKENDS = {"native": "native", "native_dense": "native", "exact": "native", "auto": "native"}
MANIFEST = "version int, backend string, model string, data string, name string, digest string, size long"


def backend(name: str) -> str:
    low = name.strip().lower()
    if low not in BACKENDS:
        raise ValueError(f"unknown backend: {name}")
    return BACKENDS[low]


@dataclass(frozen=True)
class Store:
    """Where an index lies and which model's vectors it holds."""

    root: str
    model: str

    @property
    def folder(self) -> str:
        safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in self.model).strip("._") or "item"
        return f"{self.root.rstrip('/')}/{safe}"

    @property
    def manifest(self) -> str:
        return f"{self.folder}/manifest.parquet"


def _signatures(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = None
    for p in paths:
        one = tables.file_signature(spark, p)
        out = one if out is None else out.union(one)
    return out


def build(spark: SparkSession, store: Store, chunks_path: str, embeddings_path: str, name: str = "native") -> DataFrame:
    """Write the index and then its manifest. Two builders write to different data folders; the last manifest counts."""
    data = f"{store.folder}/data-{uuid.uuid4().hex}.parquet"
    ready = index(tables.read_table(spark, chunks_path), tables.read_table(spark, embeddings_path), store.model)
    tables.write_table(ready, data)
    written = spark.read.parquet(data)
    if written.isEmpty():
        raise ValueError("no chunk has a vector of the model")
    facts = [F.lit(FORMAT).alias("version"), F.lit(backend(name)).alias("backend"), F.lit(store.model).alias("model"), F.lit(data).alias("data")]
    tables.write_table(_signatures(spark, [chunks_path, embeddings_path]).select(*facts, "name", "digest", "size"), store.manifest)
    return written


def load(spark: SparkSession, store: Store, chunks_path: str, embeddings_path: str) -> DataFrame | None:
    """The index, if there is one of this format and its inputs haven't changed."""
    recorded = tables.read_optional(spark, store.manifest, {c.split()[0]: c.split()[1] for c in MANIFEST.split(", ")})
    first = recorded.first()
    if first is None or first.version != FORMAT:
        return None
    if not tables.is_current(recorded, _signatures(spark, [chunks_path, embeddings_path])):
        return None
    return spark.read.parquet(first.data)


def open_index(spark: SparkSession, store: Store, chunks_path: str, embeddings_path: str, mode: str = "auto") -> DataFrame:
    """auto: the stored index while current, else built again; persistent: stored or an error; source: from the inputs."""
    if mode == "source":
        return index(tables.read_table(spark, chunks_path), tables.read_table(spark, embeddings_path), store.model)
    if mode not in ("auto", "persistent"):
        raise ValueError("mode must be auto, persistent or source")
    found = load(spark, store, chunks_path, embeddings_path)
    if found is None:
        if mode == "persistent":
            raise FileNotFoundError("no current index is stored")
        found = build(spark, store, chunks_path, embeddings_path)
    return found
