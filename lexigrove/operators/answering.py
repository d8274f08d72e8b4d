"""Grounded answers: context blocks, prompts, model calls as row functions, tools and a bounded tool loop.

A model is any function from text to text given by the caller; nothing here talks to a network. Over tables it runs
inside Arrow batches, after an anti-join has removed what is already answered.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import slug
from ..sources.scratch import saved
from . import knowledge as K

# What is tried again, and how far an answer may grow.
RETRIED_STATUS = {408, 409, 429, 500, 502, 503, 504}
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 6, 1.0, 30.0
MOST_TOKENS, GROWTH = 3200, 2
#: Prompts that a task holds as Python objects.
PROMPTS = 64
OPTIONAL_LINES = ["document_source", "file_name", "document_type", "section_group", "section_title"]
KNOWLEDGE_LINES = [("extracted_entities", "knowledge_entities_preview"), ("extracted_triplets", "knowledge_triplets_preview")]
REFUSAL = "I cannot provide a grounded answer from the available local evidence"


def source_block(columns: list[str]) -> Column:
    """One retrieved chunk as text; absent or empty fields leave no line."""
    parts = [
        F.format_string("[SOURCE %d]\n", F.col("rank").cast("int")),
        *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit("\n")) for c in ("doc_id", "company", "fiscal_year")],
        F.concat(F.lit("pages: "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit("\n")),
    ]
    for label, c in [(c, c) for c in OPTIONAL_LINES] + KNOWLEDGE_LINES:
        if c in columns:
            filled = F.coalesce(F.col(c), F.lit("")) != ""
            parts.append(F.when(filled, F.concat(F.lit(f"{label}: "), F.col(c), F.lit("\n"))).otherwise(""))
    parts += [F.concat(F.lit("chunk_id: "), F.col("chunk_id"), F.lit("\n")), F.concat(F.lit("text:\n"), F.col("chunk_text"), F.lit("\n"))]
    return F.concat(*parts)


def context_blocks(retrieved: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, context): the blocks of a query's chunks in rank order."""
    rows = retrieved.select(by, "rank", source_block(retrieved.columns).alias("block"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda r: r["block"])
    return rows.groupBy(by).agg(F.array_join(blocks, "\n\n").alias("context"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(
        F.lit("QUESTION:\n"), question, F.lit("\n\nRETRIEVED CONTEXT:\n"), context, F.lit("\n\nAnswer the question strictly from the retrieved context.")
    )


# Model calls ---------------------------------------------------------------------------------------------------


def request_hash(payload: dict) -> str:
    """Hash of a request: its JSON with sorted keys and without blanks."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    return status in RETRIED_STATUS if status is not None else isinstance(error, ConnectionError | TimeoutError)


def with_retries(call: Callable[[], Any], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after errors that may pass, waiting longer each time."""
    for n in range(attempts):
        try:
            return call()
        except Exception as error:
            if n + 1 >= attempts or not is_retryable(error):
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**n) * (0.5 + random.random() / 2))
    raise AssertionError("attempts must be positive")


def json_call(call: Callable[[str, int], str], prompt: str, tokens: int) -> tuple[Any, int]:
    """(parsed answer, tokens allowed): on bad JSON again with more tokens, up to a limit."""
    while True:
        text = call(prompt, tokens)
        try:
            return json.loads(text), tokens
        except json.JSONDecodeError as error:
            more = min(max(tokens + 1, tokens * GROWTH), MOST_TOKENS)
            if more <= tokens:
                raise ValueError("the model returned invalid JSON") from error
            tokens = more


def call_rows(rows: DataFrame, key: str, prompt: str, call: Callable[[str, int], str], tokens: int = 700) -> DataFrame:
    """(key, response, status, error_message): a model's JSON answer to each row's prompt; errors become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few prompts at a time are Python objects, however many rows a batch has.
            for start in range(0, batch.num_rows, PROMPTS):
                part = batch.slice(start, PROMPTS)
                out = []
                for p in part.column(1).to_pylist():
                    try:
                        answer, _ = with_retries(lambda p=p: json_call(call, p, tokens))
                        out.append((json.dumps(answer, ensure_ascii=False), "success", ""))
                    except Exception as error:
                        out.append((None, "error", str(error)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in zip(*out))], names=[key, "response", "status", "error_message"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, response string, status string, error_message string")


def extract(chunks: DataFrame, call: Callable[[str, int], str], kind: str = "entities") -> tuple[DataFrame, DataFrame]:
    """(rows, checkpoint): what a model extracts from chunks. A chunk without any row succeeds too."""
    asked = chunks.withColumn("__prompt", F.concat(F.lit(f"Extract {kind} as JSON from:\n"), "chunk_text"))
    # Stored: the rows and the checkpoint read what was answered, and no model is called again.
    answers = saved(call_rows(asked, "chunk_id", "__prompt", call), "answers")
    full = chunks.join(answers, "chunk_id")
    rows = K.entities(full) if kind == "entities" else K.triplets(full)
    counts = rows.groupBy("chunk_id").agg(F.count("*").cast("int").alias("n"))
    checkpoint = answers.join(counts, "chunk_id", "left").select("chunk_id", "status", F.coalesce("n", F.lit(0)).alias("record_count"), "error_message")
    return rows, checkpoint


def embed(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(key, embedding): vectors from an encoder called on batches of texts; it must give as many as it gets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts, out = frame[text].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                part = encode(texts[i : i + batch])
                if len(part) != len(texts[i : i + batch]):
                    raise ValueError("the encoder returned another number of vectors")
                out.extend([float(x) for x in v] for v in part)
            yield pd.DataFrame({key: frame[key].array, "embedding": out})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>")


def hash_encoder(size: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic encoder for tests: hashed words, normalised."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * size
            for w in text.lower().split():
                v[int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % size] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return encode


def direct_prompt() -> str:
    return "Use only the numbered sources. Give JSON with answer, citations (doc_id, page) and safety_flags. Say so if the sources don't hold the answer."


def judge_prompt(question: Column, context: Column, answer: Column) -> Column:
    return F.concat(F.lit("Is the answer supported by the context? Reply yes or no.\nQUESTION:\n"), question, F.lit("\nCONTEXT:\n"), context, F.lit("\nANSWER:\n"), answer)


def answer_questions(questions: DataFrame, retrieved: DataFrame, call: Callable[[str, int], str]) -> DataFrame:
    """Grounded answers for a batch: context, prompt, model, citations inside what was retrieved, safety flags.

    ``questions`` has query_id and query_text; ``retrieved`` has the ranked chunks of each. One row a question; a question
    without any chunk is asked with an empty context.
    """
    from .evaluation import json_list, valid_citations

    asked = questions.join(context_blocks(retrieved), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompted = asked.withColumn("prompt", F.concat(F.lit(direct_prompt() + "\n\n"), user_prompt(F.coalesce("query_text", F.lit("")), F.col("context"))))
    said = call_rows(prompted, "query_id", "prompt", call)
    shape = F.from_json("response", "answer string, citations string")
    out = prompted.join(said, "query_id").withColumn("answer", F.coalesce(shape["answer"], F.lit(""))).withColumn("raw", shape["citations"])
    cited = out.select(F.col("query_id").alias("question_id"), F.posexplode(json_list(F.col("raw"), "array<struct<doc_id: string, page: string>>")).alias("at", "c"))
    good = valid_citations(cited.select("question_id", "at", "c.doc_id", "c.page"), retrieved.withColumnRenamed("query_id", "question_id"))
    lists = good.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "page"))).alias("citations"))
    out = out.join(lists.withColumnRenamed("question_id", "query_id"), "query_id", "left")
    n = F.coalesce(F.size("citations"), F.lit(0))
    from ..functions import guard

    return out.select("query_id", "query_text", "context", "answer", "citations", "status", "error_message", guard.safety_flags(F.col("query_text"), F.col("answer"), F.greatest(n, F.lit(0)), F.lit(0)).alias("safety_flags"))


# Tools and the tool loop ---------------------------------------------------------------------------------------


def loose(df: DataFrame, company: str | None, year: int | None, column: str = "company", year_col: str = "year") -> DataFrame:
    """Rows of a company by letters and digits only, and of a year read as a number."""
    if company is not None and re.sub(r"[\W_]+", "", company):
        df = df.where(slug(F.col(column)) == re.sub(r"[\W_]+", "", company).lower())
    if year is not None:
        df = df.where(F.col(year_col).try_cast("int") == year)
    return df


def lookup_tool(facts: K.Knowledge, company: str | None = None, year: int | None = None, kind: str | None = None, n: int = 10) -> dict[str, DataFrame]:
    found, related = loose(facts.entities, company, year), loose(facts.triplets, company, year)
    if kind and kind.strip():
        found = found.where(F.lower("entity_type") == kind.strip().lower())
    return {
        "top_entities": K.top_counts(found, ["entity_text", "entity_type"], "year", n),
        "top_triplets": K.top_counts(related, ["relation", "entity_a", "entity_b"], "year", n),
    }


def competitor_tool(facts: K.Knowledge, company: str | None = None, year: int | None = None, n: int = 8) -> dict[str, DataFrame]:
    summary = loose(facts.clean, company, year, "source_company").orderBy(F.desc("mention_count"), "competitor_name", "source_company", "year").limit(n)
    seen = loose(facts.mentions, company, year, "source_company")
    evidence = seen.orderBy(F.desc_nulls_last("year"), "competitor_name", F.asc_nulls_last("page_start"), "chunk_id", "mention_source").limit(n)
    return {"summary": summary, "evidence": evidence}


def clamp_k(k: int) -> int:
    return max(1, min(8, k))


def arguments(text: str | dict | None) -> dict:
    """Arguments of a tool call; anything but an object is none."""
    if isinstance(text, dict):
        return text
    try:
        out = json.loads(text or "{}")
    except json.JSONDecodeError:
        return {}
    return out if isinstance(out, dict) else {}


def final_answer(text: str) -> dict:
    """A model's last message as an object; what isn't one becomes the answer, flagged."""
    text = text.strip()
    if not text:
        return {"answer": f"{REFUSAL}.", "citations": [], "safety_flags": ["empty_model_output"]}
    try:
        out = json.loads(text)
    except json.JSONDecodeError:
        return {"answer": text, "citations": [], "safety_flags": ["non_json_agent_output"]}
    return out if isinstance(out, dict) else {"answer": text, "citations": [], "safety_flags": ["non_object_agent_output"]}


def checked_citations(citations: Any, rows: list[dict]) -> list[dict]:
    """Citations inside the retrieved page ranges, once, in order."""
    out: dict[tuple[str, int], None] = {}
    for c in citations if isinstance(citations, list) else []:
        if not isinstance(c, dict) or not isinstance(c.get("doc_id"), str):
            continue
        try:
            page = int(c.get("page"))
        except (TypeError, ValueError):
            continue
        if any(r["doc_id"] == c["doc_id"] and int(r["page_start"]) <= page <= int(r["page_end"]) for r in rows):
            out[c["doc_id"], page] = None
    return [{"doc_id": d, "page": p} for d, p in out]


def flags(question: str, answer: str, citations: list, calls: list) -> list[str]:
    """Safety flags of one answer, as :func:`lexigrove.functions.guard.safety_flags` gives them for a table."""
    found = lambda text, patterns: any(re.search(p, (text or "").strip().lower()) for p in patterns)
    tests = [
        ("prompt_injection_risk", found(question, V.INJECTION)),
        ("bias_sensitive_request", found(question, V.BIAS)),
        ("low_support", not citations),
        ("grounded_refusal", found(answer, V.REFUSAL)),
        ("tool_augmented", bool(calls)),
        ("loaded_language_in_answer", found(answer, V.LOADED)),
    ]
    return [name for name, true in tests if true]


@dataclass
class Agent:
    """A loop of model turns and tool calls on the driver; tools may run Spark queries."""

    chat: Callable[[list[dict]], dict]
    tools: dict[str, Callable[..., dict]]
    most_calls: int = 3
    search: str = "search_corpus"
    trace: list[dict] = field(default_factory=list)

    def run(self, question: str) -> dict:
        messages = [{"role": "user", "content": question}]
        rows: list[dict] = []
        for _ in range(self.most_calls + 1):
            turn = self.chat(messages)
            calls = turn.get("tool_calls") or []
            if not calls:
                out = final_answer(turn.get("text") or "")
                answer = str(out.get("answer") or "").strip()
                cited = checked_citations(out.get("citations"), rows)
                own = out.get("safety_flags") if isinstance(out.get("safety_flags"), list) else []
                said = {str(f) for f in own if str(f).strip()} | set(flags(question, answer, cited, self.trace))
                return {"answer": answer, "citations": cited, "safety_flags": sorted(said), "tool_calls": self.trace, "retrieved": rows}
            left = self.most_calls - len(self.trace)
            if left <= 0:
                break
            for call in calls[:left]:
                try:
                    result = self.tools[call["name"]](**arguments(call.get("arguments")))
                    status = "success"
                    if call["name"] == self.search:
                        rows = result.get("rows", [])
                except Exception as error:
                    result, status = {"error": str(error)}, "error"
                self.trace.append({"step": len(self.trace) + 1, "tool": call["name"], "status": status, "result": result})
                messages.append({"role": "tool", "content": json.dumps(result, ensure_ascii=False, default=str)})
        answer = f"{REFUSAL} after the allowed tool calls."
        said = set(flags(question, answer, [], self.trace)) | {"max_tool_calls_reached"}
        return {"answer": answer, "citations": [], "safety_flags": sorted(said), "tool_calls": self.trace, "retrieved": rows}
