"""Tool-using answers for many questions at once: a round is a table, not a conversation.

Every question is a row with its messages. A round asks the model about all open questions, and joins the tool calls it makes to the
tools' tables: one search for all searches, one aggregate for all look-ups, one for all requests of evidence. Results become
messages, and the next round starts from the written state. There are at most ``most_calls`` calls a question and one more round
than that; a question that still calls then is refused.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..sources.scratch import saved
from . import answering as A
from . import knowledge as K
from . import retrieval

# Names of the tools, fields of a found chunk, and how many rows a tool gives.
SEARCH, LOOKUP, EVIDENCE = "search_financial_corpus", "lookup_knowledge_graph", "get_competitor_evidence"
FOUND = [
    "chunk_id", "doc_id", "company", "fiscal_year", "file_name", "document_source", "page_start", "page_end", "section_group", "section_title", "score",
    "final_score", "knowledge_score", "chunk_text",
]
MOST_FOUND, LOOKUP_ROWS, EVIDENCE_ROWS, MOST_CALLS = 8, 10, 8, 3

_MESSAGES = "array<struct<role: string, content: string>>"
_TURN = "text string, calls array<struct<tool: string, arguments: string>>"


@dataclass
class Tools:
    """What tools read: chunks with vectors, an encoder for questions, and facts (None: no facts)."""

    chunks: DataFrame
    embeddings: DataFrame
    encode: Callable[[list[str]], list[list[float]]]
    facts: K.Knowledge | None = None
    mode: str = "improved"
    k: int = 5


def _argument(name: str, *more: str) -> Column:
    found = [F.nullif(F.trim(F.get_json_object("arguments", f"$.{n}")), F.lit("")) for n in (name, *more)]
    return F.coalesce(*found)


def _number(name: str, *more: str) -> Column:
    return _argument(name, *more).try_cast("double").try_cast("int")


def _vectors(asked: DataFrame, tools: Tools) -> DataFrame:
    """(query_text, embedding) of each distinct question."""
    texts = asked.where("query_text IS NOT NULL").select("query_text").distinct()
    return A.embed(texts.withColumn("said", F.col("query_text")), "query_text", "said", tools.encode)


# Search ------------------------------------------------------------------------------------------------------------


def search(calls: DataFrame, tools: Tools) -> DataFrame:
    """Rows (call_id, error, result, context, rows) for calls (call_id, arguments): the best chunks of each, and citations to suggest.

    Arguments are question or query, top_k (1 to 8), retrieval_mode, company_filter and fiscal_year_filter.
    """
    canonical = F.coalesce(*[F.when(F.lower(_argument("retrieval_mode")).isin(list(names)), name) for name, names in retrieval.V.MODES.items()])
    asked = calls.select(
        "call_id",
        _argument("question", "query").alias("query_text"),
        F.least(F.lit(MOST_FOUND), F.greatest(F.lit(1), F.coalesce(_number("top_k"), F.lit(tools.k)))).alias("k"),
        F.when(_argument("retrieval_mode").isNull(), retrieval.mode(tools.mode)).otherwise(canonical).alias("mode"),
        _argument("company_filter").alias("company_filter"),
        _number("fiscal_year_filter").alias("fiscal_year_filter"),
    )
    wrong = F.when(F.col("query_text").isNull(), "a search needs a question").when(F.col("mode").isNull(), "unknown retrieval mode")
    asked = saved(asked.withColumn("error", wrong), "searches")
    good = asked.where("error IS NULL").withColumnRenamed("call_id", "query_id")
    ready = saved(good.join(_vectors(good, tools), "query_text"), "vectors")
    results = None
    for name in [r.mode for r in ready.select("mode").distinct().collect()]:
        facts = None if tools.facts is None else K.chunk_facts(tools.facts.entities, tools.facts.triplets)
        one = retrieval.retrieve(tools.chunks, tools.embeddings, ready.where(F.col("mode") == name), MOST_FOUND, name, facts)
        results = one if results is None else results.unionByName(one, allowMissingColumns=True)
    head = F.struct(
        F.col("query_text").alias("question"), F.col("k").alias("top_k"), F.col("mode").alias("retrieval_mode"), "company_filter", "fiscal_year_filter",
    )
    if results is None:
        return asked.select("call_id", "error", *[F.lit(None).cast("string").alias(c) for c in ("result", "context", "rows")])
    found = saved(results.join(ready.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")), "found")
    row = F.struct(*[c for c in FOUND if c in found.columns])
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("ranked"), F.count("*").alias("n"))
    both = asked.join(lists, asked.call_id == lists.query_id, "left").join(A.context_blocks(found).withColumnRenamed("query_id", "of"), F.col("call_id") == F.col("of"), "left")
    rows = F.transform(F.coalesce("ranked", F.array().cast(lists.schema["ranked"].dataType)), lambda r: r["row"])
    cited = F.transform(
        F.filter(rows, lambda r: r["doc_id"].isNotNull() & r["page_start"].isNotNull()), lambda r: F.struct(r["doc_id"].alias("doc_id"), r["page_start"].alias("page"))
    )
    context = F.coalesce("context", F.lit(""))
    result = F.to_json(
        F.struct(head["question"].alias("question"), *[head[c].alias(c) for c in ("top_k", "retrieval_mode", "company_filter", "fiscal_year_filter")],
                 F.coalesce("n", F.lit(0)).alias("n_results"), context.alias("retrieved_context"), rows.alias("retrieval_results"), cited.alias("suggested_citations")),
        {"ignoreNullFields": "false"},
    )
    good = F.col("error").isNull()
    return both.select("call_id", "error", F.when(good, result).alias("result"), F.when(good, context).alias("context"), F.when(good, F.to_json(rows)).alias("rows"))


# Facts ------------------------------------------------------------------------------------------------------------


def _filters(calls: DataFrame, *more: Column) -> DataFrame:
    company = F.nullif(slug(_argument("company")), F.lit(""))
    return calls.select("call_id", company.alias("f_company"), _number("fiscal_year").alias("f_year"), *more)


def _fitting(rows: DataFrame, wanted: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows repeated for the filters that calls use: a null filter fits any value, and only filters that were asked for are made."""
    names = list(keys)
    out = rows.withColumns(keys)
    for c in names:
        out = out.withColumn(c, F.explode(F.array_distinct(F.array(F.lit(None).cast(dict(out.dtypes)[c]), F.col(c)))))
    used = wanted.select(*[F.col(c).alias(f"u_{c}") for c in names]).distinct()
    return out.join(used, _alike(names, "u_"), "left_semi")


def _alike(names: list[str], prefix: str) -> Column:
    same = [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in names]
    return functools.reduce(Column.__and__, same)


def _answers(ranked: DataFrame, wanted: DataFrame, names: list[str], columns: list[str], label: str) -> DataFrame:
    """(call_id, label): the first rows of each call's filter as an array in order."""
    lists = ranked.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*columns).alias("row")))).alias("ranked"))
    lists = lists.select(*[F.col(c).alias(f"l_{c}") for c in names], "ranked")
    cut = F.transform(F.slice(F.col("ranked"), F.lit(1), F.col("n")), lambda r: r["row"])
    none = F.array().cast(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in ranked.select(*columns).schema)}>>")
    return wanted.join(lists, _alike(names, "l_"), "left").select("call_id", F.coalesce(cut, none).alias(label))


def _counted(rows: DataFrame, wanted: DataFrame, keys: dict[str, Column], by: list[str], n: int, label: str) -> DataFrame:
    """The most frequent values of each call's filter, with first and last year."""
    names = list(keys)
    fit = _fitting(rows, wanted, keys)
    counts = fit.groupBy(*names, *by).agg(F.count("*").alias("mentions"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("mentions"), *by))
    return _answers(counts.withColumn("place", place).where(F.col("place") <= n), wanted, names, [*by, "mentions", "first_year", "last_year"], label)


def lookup(calls: DataFrame, facts: K.Knowledge, most: int = 100) -> DataFrame:
    """(call_id, result) for calls with company, fiscal_year, entity_type and max_rows."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(_number("max_rows"), F.lit(LOOKUP_ROWS))))
    wanted = saved(_filters(calls, F.lower(_argument("entity_type")).alias("f_type"), n.alias("n")), "lookups")
    company, year = slug(F.col("company")), F.col("year").try_cast("int")
    keys = {"f_company": company, "f_year": year}
    entities = _counted(facts.entities, wanted, keys | {"f_type": F.lower("entity_type")}, ["entity_text", "entity_type"], most, "top_entities")
    triplets = _counted(facts.triplets, wanted, keys, ["relation", "entity_a", "entity_b"], most, "top_triplets")
    both = wanted.join(entities, "call_id").join(triplets, "call_id")
    return both.select("call_id", F.to_json(F.struct("top_entities", "top_triplets", F.size("top_entities").alias("entity_rows"), F.size("top_triplets").alias("triplet_rows"))).alias("result"))


def evidence(calls: DataFrame, facts: K.Knowledge, most: int = 100) -> DataFrame:
    """(call_id, result) for calls with company, fiscal_year and top_n: competitors and where they are named."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(_number("top_n"), F.lit(EVIDENCE_ROWS))))
    wanted = saved(_filters(calls, n.alias("n")), "evidence")
    keys = {"f_company": slug(F.col("source_company")), "f_year": F.col("year").try_cast("int")}
    orders = {
        "summary_rows": (facts.clean, [F.desc("mention_count"), F.asc("competitor_name"), F.asc("source_company"), F.asc("year")]),
        "evidence_rows": (facts.mentions, [F.desc_nulls_last("year"), F.asc("competitor_name"), F.asc_nulls_last("page_start"), F.asc("chunk_id"), F.asc("mention_source")]),
    }
    out = wanted.select("call_id")
    for label, (rows, order) in orders.items():
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = _fitting(rows, wanted, keys).withColumn("place", place).where(F.col("place") <= most)
        out = out.join(_answers(ranked, wanted, list(keys), rows.columns, label), "call_id")
    return out.select("call_id", F.to_json(F.struct(*orders)).alias("result"))


# Rounds -----------------------------------------------------------------------------------------------------------


def _turns(state: DataFrame, chat: Callable[[list[dict]], dict]) -> DataFrame:
    """The model's turn for each open question: (query_id, turn, failed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, messages in zip(batch["query_id"], batch["messages"]):
                try:
                    said = A.with_retries(lambda m=messages: chat(json.loads(m)))
                    calls = [{"tool": str(c.get("name")), "arguments": json.dumps(A.arguments(c.get("arguments")))} for c in said.get("tool_calls") or []]
                    out.append((key, json.dumps({"text": said.get("text") or "", "calls": calls}, ensure_ascii=False), None))
                except Exception as error:
                    out.append((key, None, str(error)))
            yield pd.DataFrame(out, columns=["query_id", "said", "failed"])

    kind = dict(state.dtypes)["query_id"]
    asked = state.select("query_id", F.to_json("messages").alias("messages"))
    return asked.mapInPandas(run, f"query_id {kind}, said string, failed string").withColumn("turn", F.from_json("said", _TURN))


def _closed(rows: DataFrame) -> DataFrame:
    """Last messages as answers: citations inside what was retrieved, safety flags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                failed, stuck = isinstance(r["failed"], str), r["stuck"]
                final = A.final_answer(r["text"] or "") if not failed and not stuck else {"answer": f"{A.REFUSAL} after the allowed tool calls." if stuck else ""}
                answer = str(final.get("answer") or "").strip()
                cited = A.checked_citations(final.get("citations"), json.loads(r["retrieved"] or "[]"))
                own = final.get("safety_flags") if isinstance(final.get("safety_flags"), list) else []
                said = {str(f) for f in own if str(f).strip()} | set(A.flags(r["query_text"] or "", answer, cited, [1] * r["used"])) | ({"max_tool_calls_reached"} if stuck else set())
                status, message = ("error", r["failed"]) if failed else ("success", "")
                out.append((r["query_id"], answer, cited, sorted(said), status, message))
            yield pd.DataFrame(out, columns=["query_id", "answer", "citations", "safety_flags", "status", "error_message"])

    kind = dict(rows.dtypes)["query_id"]
    schema = f"query_id {kind}, answer string, citations array<struct<doc_id: string, page: int>>, safety_flags array<string>, status string, error_message string"
    return rows.select("query_id", "query_text", "text", "retrieved", "used", "stuck", "failed").mapInPandas(run, schema)


def run(questions: DataFrame, chat: Callable[[list[dict]], dict], tools: Tools, most_calls: int = MOST_CALLS) -> DataFrame:
    """Answers to (query_id, query_text): answer, citations, safety_flags, tool_calls (the trace as JSON), retrieved (rows of the last search), context, status.

    ``chat`` takes messages and gives ``{"text": ...}`` or ``{"tool_calls": [{"name", "arguments"}]}``; it runs in the workers. A model
    that fails makes an error row of its question; a tool that fails makes an error message, as an unknown tool does.
    """
    first = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("query_text", F.lit("")).alias("content")))
    none = F.lit(None).cast("string")
    state = saved(
        questions.select("query_id", "query_text", first.alias("messages"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("trace"), none.alias("retrieved"), none.alias("context")),
        "state",
    )
    closed = []
    for n in range(most_calls + 1):
        now = saved(state.join(_turns(state, chat), "query_id"), "turns")
        calls_left = F.lit(most_calls) - F.col("used")
        wants = F.col("failed").isNull() & (F.size("turn.calls") > 0)
        ended = now.where(~wants | (calls_left <= 0)).withColumns({"stuck": wants, "text": F.col("turn.text")})
        closed.append(ended)
        open_ = now.where(wants & (calls_left > 0)).withColumn("todo", F.slice(F.col("turn.calls"), F.lit(1), calls_left))
        if open_.isEmpty():
            break
        calls = open_.select("query_id", "used", F.posexplode("todo").alias("place", "call")).select(
            "query_id", "place", F.concat_ws("/", F.sha2(F.col("query_id").cast("string").cast("binary"), 256), "place").alias("call_id"),
            (F.col("used") + F.col("place") + 1).alias("step"), F.col("call.tool").alias("tool"), F.col("call.arguments").alias("arguments"),
        )
        done = _called(saved(calls, "calls"), tools)
        entry = F.to_json(F.struct("step", F.col("tool").alias("tool_name"), "arguments", "status", "result"))
        content = F.coalesce("result", F.lit("{}"))
        by_question = done.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("place", entry.alias("entry"), content.alias("content")))).alias("made"),
            F.max_by(F.struct("rows", "context"), F.when(F.col("rows").isNotNull(), F.col("place"))).alias("last"),
        )
        said = F.struct(F.lit("assistant").alias("role"), F.col("said").alias("content"))
        heard = F.transform("made", lambda m: F.struct(F.lit("tool").alias("role"), m["content"].alias("content")))
        state = saved(
            open_.join(by_question, "query_id").select(
                "query_id", "query_text", F.concat("messages", F.array(said), heard).alias("messages"), (F.col("used") + F.size("made")).alias("used"),
                F.concat("trace", F.transform("made", lambda m: m["entry"])).alias("trace"), F.coalesce("last.rows", "retrieved").alias("retrieved"), F.coalesce("last.context", "context").alias("context"),
            ),
            "state",
        )
    every = closed[0]
    for part in closed[1:]:
        every = every.unionByName(part)
    rest = every.select("query_id", "query_text", F.concat(F.lit("["), F.array_join("trace", ","), F.lit("]")).alias("tool_calls"), F.coalesce("retrieved", F.lit("[]")).alias("retrieved"), F.coalesce("context", F.lit("")).alias("context"))
    return rest.join(_closed(every), "query_id")


def _called(calls: DataFrame, tools: Tools) -> DataFrame:
    """Adds status, result, rows and context to calls: each tool runs once for all of its calls."""
    kinds = [r.tool for r in calls.select("tool").where(F.col("tool").isin(SEARCH, LOOKUP, EVIDENCE)).distinct().collect()]
    parts = []
    none = F.lit(None).cast("string")
    if SEARCH in kinds:
        parts.append(search(calls.where(F.col("tool") == SEARCH), tools))
    for name, tool in ((LOOKUP, lookup), (EVIDENCE, evidence)):
        if name in kinds and tools.facts is not None:
            parts.append(tool(calls.where(F.col("tool") == name), tools.facts).select("call_id", none.alias("error"), "result", none.alias("context"), none.alias("rows")))
    if not parts:
        results = calls.limit(0).select("call_id", *[none.alias(c) for c in ("error", "result", "context", "rows")])
    else:
        results = parts[0]
        for p in parts[1:]:
            results = results.unionByName(p)
    out = calls.join(results, "call_id", "left")
    error = F.when(F.col("result").isNull(), F.coalesce("error", F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("")))))
    return out.withColumns(
        {"status": F.when(error.isNull(), "success").otherwise("error"), "result": F.coalesce("result", F.to_json(F.struct(error.alias("error"))))}
    )


def answer_directly(questions: DataFrame, tools: Tools, call: Callable[[str, int], str], k: int | None = None) -> DataFrame:
    """Grounded answers to (query_id, query_text) alone: questions are encoded, chunks retrieved and the model asked once.

    Questions may have company_filter and fiscal_year_filter. See :func:`.answering.answer_questions` for the columns.
    """
    ready = saved(questions.join(_vectors(questions, tools), "query_text"), "vectors")
    found = saved(retrieval.retrieve(tools.chunks, tools.embeddings, ready, k or tools.k, tools.mode), "found")
    return A.answer_questions(questions, found, call)
