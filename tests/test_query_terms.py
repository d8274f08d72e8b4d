import math

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.text import terms
from lexigrove.operators import query_terms, retrieval

TEXTS = [
    (1, "Companies' risks: the company's AI risks, ties and BUSES; glass's", "Risk Factors"),
    (2, None, None), (3, "", "Market risks"), (4, "a ai US 's x-ray's dogs-ies naïve’s ſs İs", ""), (5, "risk " * 900 + "bus", None),
]
ASKED = [(10, "risks of companies and risk of a bus"), (20, None), (30, "AI glass tie dogs-y market naïve"), (40, "the of and")]


def _pairs(spark):
    chunks = spark.createDataFrame(TEXTS, "chunk_id int, chunk_text string, section_title string")
    queries = spark.createDataFrame(ASKED, "query_id int, query_text string")
    return chunks, queries, queries.crossJoin(chunks)


def test_counts_are_those_of_terms(spark):
    _, _, pairs = _pairs(spark)
    whole = F.concat(F.coalesce("section_title", F.lit("")), F.lit("\n"), F.coalesce("chunk_text", F.lit("")))
    pairs = pairs.withColumns({"q": F.array_distinct(terms(F.col("query_text"), True)), "own": terms(F.col("chunk_text")), "all": terms(whole)})
    for r in query_terms.counted(pairs, "q", "chunk_text", "section_title").collect():
        assert r.dl == len(r["all"])
        assert r.covered == len(set(r.q) & set(r.own))
        assert {r.q[h["at"]]: h.tf for h in r.hits} == {t: r["all"].count(t) for t in r.q if t in r["all"]}


def test_bm25_against_loops_and_no_term_of_a_text_is_a_row(spark):
    chunks, queries, pairs = _pairs(spark)
    pairs = pairs.select("query_id", "chunk_id", F.col("chunk_text").alias("text"))
    cut = {r.chunk_id: r.t for r in chunks.select("chunk_id", terms(F.col("chunk_text")).alias("t")).collect()}
    asked = {r.query_id: r.t for r in queries.select("query_id", terms(F.col("query_text"), True).alias("t")).collect()}
    average = max(1.0, sum(map(len, cut.values())) / len(cut))
    out = retrieval.bm25(pairs, queries)
    assert "regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        want = 0.0
        for t in set(asked[r.query_id]):
            df, tf = sum(t in c for c in cut.values()), cut[r.chunk_id].count(t)
            want += asked[r.query_id].count(t) * math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(cut[r.chunk_id]) / average))
        assert r.bm25_score == pytest.approx(want)
    assert out.count() == len(TEXTS) * len(ASKED)


def test_a_memo_that_is_full_is_emptied(monkeypatch):
    monkeypatch.setattr(query_terms, "MEMO", 2)
    stems = query_terms.Stems()
    assert [stems[t] for t in ("Cities", "a", "AI", "boss's", "Cities")] == ["city", None, "ai", "boss", "city"]
    assert len(stems) <= 2
