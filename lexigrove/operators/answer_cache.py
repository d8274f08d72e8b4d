"""Content-addressed cache of model answers: one call for each distinct request, none for one that was answered before.

A request is its prompt, model, tokens and task; its hash is its address. Rows are reduced to distinct requests, those with a successful
record are left out by an anti-join, the rest is called once each and its records are published as one part (see
sources/versions) before anybody reads an answer. Answers then go to all rows of their request. Parts are laid out by the first digit of
the hash, so that a look-up reads what it needs. Errors are records too, but they are asked again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from ..sources.versions import Versions
from .incremental import keep_last

RECORD = ["request_hash", "bucket", "task", "model", "response", "status", "error_message", "tokens_used", "answered_at"]


def address(prompt: Column, model: str, tokens: int, task: str) -> Column:
    """Hash of a request: its JSON with keys in order and without blanks."""
    request = F.struct(F.lit(model).alias("model"), F.coalesce(prompt, F.lit("")).alias("prompt"), F.lit(task).alias("task"), F.lit(tokens).alias("tokens"))
    return F.sha2(F.to_json(request).cast("binary"), 256)


@dataclass(frozen=True)
class AnswerCache:
    store: Versions

    def records(self) -> DataFrame | None:
        """All records, if there are any."""
        return self.store.read() if self.store.current()[1].get("parts") else None

    def answered(self) -> DataFrame | None:
        """The last successful record of each request."""
        found = self.records()
        return None if found is None else keep_last(found.where("status = 'success'"), ["request_hash"], ["answered_at", F.xxhash64("response")])

    def compact(self) -> None:
        """Leave the last successful record of each request, in one part."""
        self.store.compact(lambda r: keep_last(r.where("status = 'success'"), ["request_hash"], ["answered_at", F.xxhash64("response")]))

    def ask(self, rows: DataFrame, key: str, prompt: str, call: Callable[[str, int], str], model: str = "model", tokens: int = 700, task: str = "generic") -> DataFrame:
        """(key, request_hash, response, status, error_message, from_cache): a model's JSON answer to each row's prompt.

        Equal prompts share one call; a null prompt is the empty one. ``call`` takes a prompt and a number of tokens.
        """
        from .answering import PROMPTS, json_call, with_retries

        asked = saved(rows.select(F.col(key).alias("key"), F.coalesce(prompt, F.lit("")).alias("prompt"), address(F.col(prompt), model, tokens, task).alias("request_hash")), "asked")
        before = self.answered()
        wanted = asked.select("request_hash").distinct()
        left = asked.groupBy("request_hash").agg(F.min("prompt").alias("prompt"))
        hit = None
        if before is not None:
            bucket = F.substring("request_hash", 1, 1)
            hit = saved(before.join(wanted.withColumn("bucket", bucket), ["bucket", "request_hash"], "left_semi"), "hits")
            left = left.join(hit.select("request_hash"), "request_hash", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Few prompts at a time are Python objects, however many rows a batch has.
                for start in range(0, batch.num_rows, PROMPTS):
                    part = batch.slice(start, PROMPTS)
                    out = []
                    for p in part.column(1).to_pylist():
                        try:
                            answer, used = with_retries(lambda p=p: json_call(call, p, tokens))
                            out.append((json.dumps(answer, ensure_ascii=False), "success", "", used))
                        except Exception as error:
                            out.append((None, "error", str(error), tokens))
                    said = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *said], names=["request_hash", "response", "status", "error_message", "tokens_used"])

        # Dealt by address, so calls are spread whatever the order of the rows; written once, so nothing is called again when answers are read.
        called = left.select("request_hash", "prompt").repartition(F.col("request_hash")).mapInArrow(run, "request_hash string, response string, status string, error_message string, tokens_used int")
        record = called.withColumns(
            {"bucket": F.substring("request_hash", 1, 1), "task": F.lit(task), "model": F.lit(model), "answered_at": F.current_timestamp()}
        ).select(*RECORD)
        fresh = saved(record, "answers")
        if not fresh.isEmpty():
            self.store.append(fresh.repartitionByRange(16, "bucket", "request_hash").sortWithinPartitions("bucket", "request_hash"))
        columns = ["request_hash", "response", "status", "error_message"]
        known = fresh.select(*columns, F.lit(False).alias("from_cache"))
        if hit is not None:
            known = known.unionByName(hit.select(*columns, F.lit(True).alias("from_cache")))
        return asked.join(known, "request_hash").select(F.col("key").alias(key), *columns, "from_cache")
