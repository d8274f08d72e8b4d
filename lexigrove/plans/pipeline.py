"""A full run as a graph of steps: each is signed by what goes into it, and only what changed runs again.

A step's signature covers its name, its options and the signatures of its inputs. Its output is a version of its table (see
sources/versions), published with the signature when it is whole. A run goes through the steps in order and skips those whose
newest version carries their signature, so a run that was killed repeats the one step that it was in, and a changed option
repeats that step and those that depend on it. Rows that called a model are kept by the answer cache, so even a repeated step asks only what is new;
rows that failed are rows of the output, with status ``error``, and are asked again by the next run. What steps did is logged.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answering, chunking, evaluation, knowledge, retrieval
from ..operators.answer_cache import AnswerCache
from ..sources.scratch import saved
from ..sources.versions import Versions

# Phases in order, and the retrieval modes that are compared.
PHASES = ("preparation", "indexing", "extraction", "financebench", "evaluation", "judge", "metrics")
COMPARED = ("classical_ml", "naive", "improved")


@dataclass(frozen=True)
class Step:
    """``make`` gets the tables of ``inputs`` by name and the run; ``options`` are what its result depends on besides."""

    name: str
    phase: str
    inputs: tuple[str, ...]
    make: Callable[[dict[str, DataFrame], Run], DataFrame]
    options: dict = field(default_factory=dict, hash=False)


@dataclass
class Run:
    """Where steps write, and the models they call. ``sources`` are given tables with a signature of each."""

    spark: SparkSession
    root: str
    sources: dict[str, tuple[DataFrame, str]]
    encode: Callable[[list[str]], list[list[float]]]
    call: Callable[[str, int], str]
    model: str = "model"

    def table(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.root.rstrip('/')}/{name}")

    @property
    def cache(self) -> AnswerCache:
        return AnswerCache(self.table("answers_cache"))

    def signature(self, step: Step, known: dict[str, str]) -> str:
        return hashlib.sha256(json.dumps([step.name, step.options, self.model, [known[i] for i in step.inputs]], sort_keys=True).encode()).hexdigest()


def _pages(t: dict[str, DataFrame], run: Run) -> DataFrame:
    return chunking.process_pages(t["pages"])


def _chunks(method: str, **sizes) -> Callable[[dict[str, DataFrame], Run], DataFrame]:
    return lambda t, run: chunking.chunk_documents(t["clean_pages"], method, **sizes)


def _vectors(t: dict[str, DataFrame], run: Run) -> DataFrame:
    return answering.embed(t["chunks"], "chunk_id", "chunk_text", run.encode)


def _extracted(kind: str) -> Callable[[dict[str, DataFrame], Run], DataFrame]:
    def make(t: dict[str, DataFrame], run: Run) -> DataFrame:
        prompt = F.concat(F.lit(f"Extract {kind} as JSON from:\n"), "chunk_text")
        said = run.cache.ask(t["chunks"].withColumn("__prompt", prompt), "chunk_id", "__prompt", run.call, run.model, task=kind)
        return t["chunks"].join(said.select("chunk_id", "response", "status", "error_message"), "chunk_id")

    return make


def _facts(t: dict[str, DataFrame], run: Run) -> DataFrame:
    return knowledge.chunk_facts(knowledge.entities(t["entity_answers"]), knowledge.triplets(t["triplet_answers"]))


def _questions(t: dict[str, DataFrame], run: Run) -> DataFrame:
    return evaluation.load_questions(t["questions"], "question_order" if "question_order" in t["questions"].columns else t["questions"].columns[0])


def _retrieved(mode: str, k: int) -> Callable[[dict[str, DataFrame], Run], DataFrame]:
    def make(t: dict[str, DataFrame], run: Run) -> DataFrame:
        asked = t["question_set"].select(F.col("question_id").alias("query_id"), F.col("question").alias("query_text"), "company_filter", "fiscal_year_filter")
        texts = asked.select("query_text").distinct().withColumn("said", F.col("query_text"))
        ready = saved(asked.join(answering.embed(texts, "query_text", "said", run.encode), "query_text"), "vectors")
        return retrieval.retrieve(t["chunks"], t["vectors"], ready, k, mode, t["facts"] if mode == "improved" else None)

    return make


def _answers(mode: str) -> Callable[[dict[str, DataFrame], Run], DataFrame]:
    def make(t: dict[str, DataFrame], run: Run) -> DataFrame:
        found, asked = t[f"retrieved_{mode}"], t["question_set"]
        blocks = answering.context_blocks(found).withColumnRenamed("query_id", "question_id")
        rows = asked.join(blocks, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        rows = saved(rows.withColumn("__prompt", F.concat(F.lit(answering.direct_prompt() + "\n\n"), answering.user_prompt(F.col("question"), F.col("context")))), "prompts")
        said = run.cache.ask(rows, "question_id", "__prompt", run.call, run.model, task="answer")
        shape = F.from_json("response", "answer string, citations string")
        counts = found.groupBy(F.col("query_id").alias("question_id")).agg(F.count("*").cast("int").alias("n_retrieved_chunks"))
        out = rows.drop("__prompt").join(said.drop("request_hash", "from_cache"), "question_id").join(counts, "question_id", "left")
        return out.select(
            *asked.columns, F.col("context").alias("retrieved_context"), F.coalesce(shape["answer"], F.lit("")).alias("generated_answer"),
            F.coalesce(shape["citations"], F.lit("[]")).alias("citations"), F.coalesce("n_retrieved_chunks", F.lit(0)).alias("n_retrieved_chunks"),
            "status", "error_message", F.lit(mode).alias("retrieval_mode"),
        )

    return make


def _judged(mode: str) -> Callable[[dict[str, DataFrame], Run], DataFrame]:
    def make(t: dict[str, DataFrame], run: Run) -> DataFrame:
        rows = t[f"answers_{mode}"]
        prompt = answering.judge_prompt(F.col("question"), F.col("retrieved_context"), F.col("generated_answer"))
        wanted = rows.where(evaluation.shortcut(F.col("generated_answer"), F.col("retrieved_context")).isNull())
        said = run.cache.ask(wanted.withColumn("__prompt", prompt), "question_id", "__prompt", run.call, run.model, task="judge")
        verdicts = said.select("question_id", F.get_json_object("response", "$.verdict").alias("__said"), (F.col("status") == "error").alias("__failed"))
        judged = evaluation.judge(rows.join(verdicts, "question_id", "left"), F.col("__said"))
        # A judge that failed says no, as an error.
        failed = F.coalesce("__failed", F.lit(False))
        return judged.withColumns(
            {"judge_status": F.when(failed, "error").otherwise(F.col("judge_status")), "judge_verdict": F.when(failed, "No").otherwise(F.col("judge_verdict"))}
        ).drop("__said", "__failed")

    return make


def _metrics(t: dict[str, DataFrame], run: Run) -> DataFrame:
    out = None
    for mode in COMPARED:
        one = evaluation.summary_metrics(evaluation.enrich(t[f"judged_{mode}"])).withColumn("retrieval_mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def steps(method: str = "token", k: int = 5, **sizes) -> list[Step]:
    """The graph of a run. Sources are ``pages`` (doc_id, company, fiscal_year, page_num, raw_text) and ``questions``."""
    out = [
        Step("clean_pages", "preparation", ("pages",), _pages),
        Step("chunks", "preparation", ("clean_pages",), _chunks(method, **sizes), {"method": method, **sizes}),
        Step("vectors", "indexing", ("chunks",), _vectors),
        Step("entity_answers", "extraction", ("chunks",), _extracted("entities")),
        Step("triplet_answers", "extraction", ("chunks",), _extracted("triplets")),
        Step("facts", "extraction", ("entity_answers", "triplet_answers"), _facts),
        Step("question_set", "financebench", ("questions",), _questions),
    ]
    for m in COMPARED:
        inputs = ("chunks", "vectors", "question_set") + (("facts",) if m == "improved" else ())
        out.append(Step(f"retrieved_{m}", "evaluation", inputs, _retrieved(m, k), {"k": k}))
        out.append(Step(f"answers_{m}", "evaluation", (f"retrieved_{m}", "question_set"), _answers(m)))
    out += [Step(f"judged_{m}", "judge", (f"answers_{m}",), _judged(m)) for m in COMPARED]
    return [*out, Step("metrics", "metrics", tuple(f"judged_{m}" for m in COMPARED), _metrics)]


def select_steps(first: str = PHASES[0], last: str = PHASES[-1], graph: list[Step] | None = None) -> list[Step]:
    """Steps of the phases from one to another."""
    names = [n.strip().lower() for n in (first, last)]
    unknown = [n for n in names if n not in PHASES]
    if unknown:
        raise ValueError(f"unknown phase: {unknown}")
    a, b = map(PHASES.index, names)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return [s for s in (steps() if graph is None else graph) if a <= PHASES.index(s.phase) <= b]


def execute(run: Run, graph: list[Step], force: bool = False) -> dict[str, str]:
    """Run the steps that aren't current; what became of each: ran or current. The first that fails is logged and raised.

    An output with rows of status ``error`` isn't current: its step runs again and the cache asks only those rows.
    """
    signatures = {name: signed for name, (_, signed) in run.sources.items()}
    done: dict[str, str] = {}
    log = run.table("log")
    for step in graph:
        store = run.table(step.name)
        for name in step.inputs:
            if name not in signatures:
                # A step of an earlier phase, that isn't among these: its newest version counts.
                signed = run.table(name).current()[1].get("signature")
                if signed is None:
                    raise FileNotFoundError(f"{step.name} needs {name}, which hasn't been made")
                signatures[name] = signed
        signed = run.signature(step, signatures)
        manifest = store.current()[1]
        signatures[step.name] = manifest.get("content", signed) if manifest.get("signature") == signed else signed
        if manifest.get("signature") == signed and not manifest.get("errors") and not force:
            done[step.name] = "current"
            continue
        began, status, message = time.time(), "killed", ""
        try:
            tables = {n: run.sources[n][0] if n in run.sources else run.table(n).read() for n in step.inputs}
            name = store.new_part(step.make(tables, run))
            made = store.part(name)
            errors = made.where("status = 'error'").count() if "status" in made.columns else 0
            # Rows that were errors may be others next time, and so may be what is made from them.
            content = signed if not errors and not manifest.get("errors") else hashlib.sha256(f"{signed} {name}".encode()).hexdigest()
            store.commit(lambda m, name=name, errors=errors, content=content, signed=signed: m | {"parts": [name], "signature": signed, "content": content, "errors": errors})
            signatures[step.name] = content
            done[step.name], status, message = "ran", "success", ""
        except Exception as error:
            status, message = "error", str(error)[:1000]
            raise
        finally:
            entry = [(step.name, step.phase, status, message, round(time.time() - began, 3))]
            log.append(run.spark.createDataFrame(entry, "step string, phase string, status string, error_message string, seconds double"))
    return done
