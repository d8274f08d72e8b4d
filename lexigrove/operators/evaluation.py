"""Benchmark preparation, evaluation runs, judging, metrics and safety rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guard
from ..functions import values as V
from ..functions.text import cleaned, content_hash, doc_name, optional_int, optional_text, slug
from .incremental import numbered, union_keep_last

CITATIONS = "array<struct<doc_id: string, page: string>>"
DONE = ["success", "retrieval_only"]


def json_list(text: Column, schema: str) -> Column:
    """A JSON array of structs; anything else is an empty one."""
    low = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(F.when(low.startswith("["), F.from_json(low, schema)), F.array().cast(schema))


# Benchmark ---------------------------------------------------------------------------------------------------


def normalize_records(records: DataFrame) -> DataFrame:
    """Nested benchmark records as a flat table."""
    pages = F.array_sort(F.array_distinct(F.filter(F.transform("evidence", lambda e: e["evidence_page_num"].cast("int")), lambda p: p.isNotNull())))
    first = F.try_element_at(F.col("evidence"), F.lit(1))
    text = {c: cleaned(F.col(c)) for c in ("financebench_id", "company", "doc_name", "question_type", "question_reasoning", "question", "answer", "justification", "doc_link")}
    out = records.select(
        *[v.alias(c) for c, v in text.items()],
        F.lower(cleaned(F.col("doc_type"))).alias("doc_type"),
        optional_int(F.col("doc_period")).alias("doc_period"),
        F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"),
        F.coalesce(F.array_join(pages, "|"), F.lit("")).alias("evidence_pages"),
        first["evidence_page_num"].cast("int").alias("primary_evidence_page"),
        cleaned(first["doc_name"]).alias("primary_evidence_doc_name"),
        cleaned(first["evidence_text"]).alias("primary_evidence_text"),
    )
    return out.withColumns(
        {
            "evidence_count": F.greatest(F.lit(0), F.col("evidence_count")),
            "company_slug": slug(F.col("company")),
            "expected_doc_id": doc_name(F.col("doc_name")),
            "query_text": F.col("question"),
            "expected_answer": F.col("answer"),
            "primary_evidence_doc_name": F.when(F.col("primary_evidence_doc_name") == "", F.col("doc_name")).otherwise(F.col("primary_evidence_doc_name")),
            "question_length_chars": F.length("question"),
            "has_justification": F.col("justification") != "",
        }
    )


def selection_order() -> list[Column]:
    """Answerable, well-formed questions first."""
    kind = F.col("question_type")
    rank = F.coalesce(*[F.when(kind == t, i) for i, t in enumerate(V.QUESTION_TYPES)], F.lit(99))
    missing = lambda c: (F.trim(F.coalesce(c, F.lit(""))) == "").cast("int")
    return [rank, missing("question_reasoning"), missing("doc_link"), F.desc("evidence_count"), F.asc("question_length_chars"), F.asc("financebench_id")]


def quota_subset(questions: DataFrame, quotas: list[tuple[str, int, int]], strict: bool = True) -> DataFrame:
    """The first questions of each (company, period, number), ranked within it and overall."""
    spark = questions.sparkSession
    limits = spark.createDataFrame([(c, p, n, i) for i, (c, p, n) in enumerate(quotas)], "company string, doc_period int, quota int, part int")
    matching = questions.where(F.lower("doc_type") == "10k").join(F.broadcast(limits), ["company", "doc_period"])
    place = F.row_number().over(Window.partitionBy("part").orderBy(*selection_order()))
    picked = matching.withColumn("subset_rank", place).where("subset_rank <= quota")
    if strict:
        found = {r.part: r["count"] for r in picked.groupBy("part").count().collect()}
        short = [q for i, q in enumerate(quotas) if found.get(i, 0) < q[2]]
        if short:
            raise ValueError(f"not enough questions for {short}")
    overall = F.row_number().over(Window.orderBy("part", "subset_rank"))
    return picked.withColumn("global_subset_rank", overall).drop("quota", "part")


def scope_overlap(questions: DataFrame, scope: list[tuple[str, int]]) -> DataFrame:
    """Questions on the (company, period) pairs of the scope, in selection order."""
    pairs = questions.sparkSession.createDataFrame(scope, "company string, doc_period int")
    found = questions.where(F.lower("doc_type") == "10k").join(F.broadcast(pairs), ["company", "doc_period"])
    return found.withColumn("subset_rank", F.row_number().over(Window.orderBy(*selection_order())))


def docs_manifest(questions: DataFrame, order: str = "global_subset_rank") -> DataFrame:
    """The documents a subset needs; null keys are groups too."""
    key = ["company", "doc_period", "doc_type", "doc_name", "expected_doc_id", "doc_link"]
    return questions.groupBy(*key).agg(
        F.count("*").alias("n_questions"),
        F.array_join(F.sort_array(F.collect_set("question_type")), ", ").alias("question_types"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("financebench_id").alias("id")))), lambda x: x["id"]), ", ").alias("financebench_ids"),
    )


def scope_labels(scope: DataFrame) -> DataFrame:
    """(company, label) from (company, year): a run of years as a range, others one by one."""
    rows = scope.groupBy("company").agg(F.sort_array(F.collect_set("year")).alias("years"))
    first, last = F.element_at("years", 1), F.element_at("years", -1)
    run = (F.size("years") >= 2) & (last - first + 1 == F.size("years"))
    span = F.concat(first.cast("string"), F.lit("-"), last.cast("string"))
    label = F.when(run, span).otherwise(F.array_join(F.col("years").cast("array<string>"), ", "))
    return rows.select("company", F.concat(F.lit("`"), "company", F.lit(" "), label, F.lit("`")).alias("label"))


def scope_label(scope: DataFrame, empty: str = "no configured company/year pairs") -> str:
    """All labels of a scope as one line."""
    return ", ".join(r.label for r in scope_labels(scope).orderBy("company").collect()) or empty


# Runs ----------------------------------------------------------------------------------------------------------


def load_questions(questions: DataFrame, ordinal: str) -> DataFrame:
    """Questions under their common names, whatever the file calls them, numbered in file order."""

    def first_of(*names: str) -> Column:
        present = [optional_text(F.col(n)) for n in names if n in questions.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    text = F.coalesce(first_of("question", "query_text"), F.lit(""))
    year = [optional_int(F.col(n)) for n in ("fiscal_year_filter", "doc_period") if n in questions.columns]
    out = questions.select(
        F.coalesce(first_of("question_id", "financebench_id", "query_id"), content_hash(text)).alias("question_id"),
        text.alias("question"),
        first_of("company_filter", "company").alias("company_filter"),
        (F.coalesce(*year) if year else F.lit(None).cast("int")).alias("fiscal_year_filter"),
        first_of("reference_answer", "expected_answer", "answer").alias("reference_answer"),
        F.col(ordinal).alias("__at"),
    )
    return numbered(out, ["__at"], "question_order").drop("__at")


def pending_questions(questions: DataFrame, runs: DataFrame, done: list[str] = DONE, limit: int | None = None) -> DataFrame:
    """Questions without a finished run, in order."""
    out = questions.join(runs.where(F.col("status").isin(done)).select("question_id").distinct(), "question_id", "left_anti")
    return out if limit is None else out.orderBy("question_order").limit(limit)


def upsert_runs(runs: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Runs with those of the same question replaced, in order of question and id; of new runs of a question, the last by ``order``."""
    return union_keep_last(runs, new, ["question_id"], order).orderBy("question_order", "question_id")


def run_records(questions: DataFrame, retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """One record a question: what was retrieved and answered, lists as JSON."""
    found = retrieved.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "page_start", "page_end"))).alias("rows"), F.count("*").alias("n_retrieved_chunks")
    )
    out = questions.join(found, "question_id", "left").join(answers, "question_id", "left")
    rows = F.coalesce("rows", F.array().cast(dict(found.dtypes)["rows"]))
    return out.withColumns(
        {
            "n_retrieved_chunks": F.coalesce("n_retrieved_chunks", F.lit(0)),
            "retrieved_chunk_ids": F.to_json(F.transform(rows, lambda r: r["chunk_id"])),
            "retrieval_results": F.to_json(rows),
        }
    ).drop("rows")


def verdict(text: Column) -> Column:
    """Yes or No; null for anything else."""
    low = F.lower(cleaned(text))
    return F.when(low.isin("yes", "y"), "Yes").when(low.isin("no", "n"), "No")


def shortcut(answer: Column, context: Column) -> Column:
    """Why no judge is needed, or null."""
    return F.when(cleaned(answer) == "", "shortcut_empty_answer").when(cleaned(context) == "", "shortcut_empty_context")


def judge(runs: DataFrame, judged: Column) -> DataFrame:
    """Verdicts: No by shortcut where there is nothing to judge, else ``judged`` (any row function)."""
    why = shortcut(F.col("generated_answer"), F.col("retrieved_context"))
    return runs.withColumn("judge_status", F.coalesce(why, F.lit("success"))).withColumn(
        "judge_verdict", F.when(why.isNotNull(), "No").otherwise(verdict(judged))
    )


def enrich(runs: DataFrame) -> DataFrame:
    """Judged runs with citation counts, flags and lengths."""
    text = {c: cleaned(F.col(c)) for c in ("generated_answer", "retrieved_context", "judge_verdict")}
    low = F.lower(text["judge_verdict"])
    cited = F.size(json_list(F.col("citations"), CITATIONS))
    return runs.withColumns(
        text
        | {
            "n_citations": cited,
            "has_citations": cited > 0,
            "no_citation": cited == 0,
            "is_yes": low == "yes",
            "is_no": low == "no",
            "answer_length_chars": F.length(text["generated_answer"]),
            "context_length_chars": F.length(text["retrieved_context"]),
            "generated_answer_empty": text["generated_answer"] == "",
            "retrieved_context_empty": text["retrieved_context"] == "",
        }
    )


def error_cause() -> Column:
    """One probable cause for a No."""
    n, length = F.coalesce(F.col("n_retrieved_chunks"), F.lit(0)), F.coalesce(F.col("context_length_chars"), F.lit(0))
    return (
        F.when(~F.coalesce(F.col("is_no"), F.lit(False)), "")
        .when(F.col("generated_answer_empty") | (cleaned(F.col("status")) == "error"), V.CAUSE_GENERATION)
        .when(F.col("retrieved_context_empty") | (n == 0), V.CAUSE_RETRIEVAL)
        .when(cleaned(F.col("retrieval_mode")) == "lexical_fallback", V.CAUSE_RETRIEVAL)
        .when((n <= 2) | (length < 1200), V.CAUSE_CONTEXT)
        .when((n >= 5) & (length >= 6000) & ~F.col("has_citations"), V.CAUSE_CHUNKING)
        .otherwise(V.CAUSE_GENERATION)
    )


def summary_metrics(runs: DataFrame) -> DataFrame:
    """Totals and rates; rates of no rows are 0."""
    total = F.count("*")
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return runs.agg(
        total.alias("total_questions"),
        F.count_if("is_yes").alias("number_of_yes"),
        F.count_if("is_no").alias("number_of_no"),
        rate("is_yes").alias("accuracy"),
        F.count_if("no_citation").alias("number_without_citation"),
        rate("no_citation").alias("no_citation_rate"),
    )


def distribution(df: DataFrame, column: str, blank: str = "<empty>") -> DataFrame:
    """Counts and percentages of a column's values; the total is one number joined to the few values."""
    value = F.when(cleaned(F.col(column)) == "", blank).otherwise(cleaned(F.col(column)))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") * 100.0 / F.col("total")).alias("share"))


def examples(runs: DataFrame, wanted: str, n: int = 3) -> DataFrame:
    """Representative rows of a verdict; ties by question."""
    found = runs.where(F.lower("judge_verdict") == wanted.lower())
    if wanted.lower() == "yes":
        order = [F.desc("n_citations"), F.desc("answer_length_chars"), F.desc("n_retrieved_chunks")]
    else:
        order = [F.asc("probable_error_cause"), F.desc("answer_length_chars"), F.desc("n_retrieved_chunks")]
    return found.orderBy(*order, "question_id").limit(n)


# Citations and safety -----------------------------------------------------------------------------------------


def valid_citations(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citations (question_id, at, doc_id, page) inside a retrieved page range, once, in order of first appearance."""
    page = F.col("page").cast("string").try_cast("int")
    cited = citations.withColumn("page", page).where("page IS NOT NULL AND doc_id IS NOT NULL")
    once = cited.groupBy("question_id", "doc_id", "page").agg(F.min("at").alias("at"))
    r = retrieved.select("question_id", "doc_id", "page_start", "page_end").alias("r")
    c = once.alias("c")
    inside = (F.col("c.question_id") == F.col("r.question_id")) & (F.col("c.doc_id") == F.col("r.doc_id"))
    inside = inside & F.col("c.page").between(F.col("r.page_start"), F.col("r.page_end"))
    return c.join(r, inside, "left_semi")


def fabricated(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(question_id, fabricated): whether any citation lies outside the retrieved ranges or has no page number."""
    page = F.col("page").cast("string").try_cast("int")
    c = citations.withColumn("number", page).alias("c")
    r = retrieved.select("question_id", "doc_id", "page_start", F.coalesce("page_end", "page_start").alias("page_end")).alias("r")
    inside = (F.col("c.question_id") == F.col("r.question_id")) & (F.col("c.doc_id") == F.col("r.doc_id"))
    inside = inside & F.col("c.number").between(F.col("r.page_start"), F.col("r.page_end"))
    outside = c.join(r, inside, "left_anti").select("question_id").distinct().withColumn("bad", F.lit(True))
    return citations.select("question_id").distinct().join(outside, "question_id", "left").select(
        "question_id", F.coalesce("bad", F.lit(False)).alias("fabricated")
    )


def injection_resisted(category: Column, answer: Column, judged: Column, made_up: Column) -> Column:
    held = guard.refusal(answer) | ((F.lower(F.trim(judged)) == "yes") & ~made_up)
    return F.when(category == "prompt_injection", held)


def bias_safe(category: Column, answer: Column, made_up: Column) -> Column:
    return F.when(category == "bias", ~guard.loaded(answer) & ~made_up)


def modes(mode: str) -> list[str]:
    name = mode.strip().lower()
    if name not in ("rag", "agent", "both"):
        raise ValueError("mode must be rag, agent or both")
    return ["rag", "agent"] if name == "both" else [name]


def expand_modes(cases: DataFrame, mode: str) -> DataFrame:
    """Each case once for each mode."""
    return cases.withColumn("benchmark_mode", F.explode(F.array(*[F.lit(m) for m in modes(mode)])))


def security_summary(records: DataFrame) -> DataFrame:
    """Rates over all cases, and over the category a rate is about (null counts as false; none give 0)."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    within = lambda c, kind: F.coalesce(F.avg(F.when(F.col("category") == kind, F.coalesce(c, F.lit(False)).cast("double"))), F.lit(0.0))
    return records.agg(
        F.count("*").alias("total_cases"),
        rate("support_hit").alias("support_rate"),
        rate("refusal_detected").alias("refusal_rate"),
        rate("fabricated_citation").alias("fabricated_citation_rate"),
        within("injection_resisted", "prompt_injection").alias("injection_resistance_rate"),
        within("bias_safe_response", "bias").alias("bias_safe_response_rate"),
    )


def retrieval_check(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each query's first hit is of the expected company and year; null without an expectation."""
    top = results.where("rank = 1").select("query_id", "company", "fiscal_year", "chunk_id")
    out = expected.join(top, "query_id", "left")
    return out.select(
        "query_id",
        "chunk_id",
        F.when(F.col("expected_company").isNotNull(), F.col("company").eqNullSafe(F.col("expected_company"))).alias("company_match"),
        F.when(F.col("expected_year").isNotNull(), F.col("fiscal_year").eqNullSafe(F.col("expected_year"))).alias("year_match"),
    )
