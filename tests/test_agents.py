import json

import pytest

from lexigrove.operators import agents, answering, knowledge


@pytest.fixture(scope="module")
def tools(spark):
    long = " The report goes on with many more words so that it is no navigation " * 5
    chunks = spark.createDataFrame(
        [
            ("c1", "adobe_2022_10k", "adobe", 2022, 1, 2, "Adobe faces competition from Figma." + long),
            ("c2", "pfizer_2022_10k", "pfizer", 2022, 7, 7, "Pfizer reports vaccine revenue." + long),
            ("c3", "adobe_2023_10k", "adobe", 2023, 4, 4, "Adobe products and segments." + long),
        ],
        "chunk_id string, doc_id string, company string, fiscal_year int, page_start int, page_end int, chunk_text string",
    )
    encode = answering.hash_encoder()
    vectors = answering.embed(chunks, "chunk_id", "chunk_text", encode)
    entity = "chunk_id string, entity_text string, entity_type string, confidence double, source_doc_id string, year int, company string, page_start int, page_end int, ordinal int"
    found = spark.createDataFrame(
        [("c1", "Figma", "company", 0.9, "d", 2022, "Adobe", 1, 1, 0), ("c3", "Figma", "company", 0.9, "d", 2023, "adobe", 4, 4, 0), ("c3", "Photoshop", "product", 0.9, "d", 2023, "adobe", 4, 4, 1), ("c2", "Comirnaty", "product", 0.9, "d", 2022, "pfizer", 7, 7, 0)], entity
    )
    triplet = "chunk_id string, entity_a string, relation string, entity_b string, year int, company string, doc_id string, page_start int, page_end int, ordinal int"
    related = spark.createDataFrame([("c1", "Adobe", "COMPETES_WITH", "Figma", 2022, "adobe", "d", 1, 1, 0)], triplet)
    return agents.Tools(chunks, vectors, encode, knowledge.knowledge(found, related, chunks))


def ask(name, **arguments):
    return {"name": name, "arguments": json.dumps(arguments)}


def test_search_tool(spark, tools):
    calls = [("a", {"question": "Adobe competition Figma", "top_k": 1, "company_filter": "adobe"}), ("b", {"query": "vaccine revenue", "retrieval_mode": "ml", "top_k": 99}), ("c", {"question": " "}), ("d", {"query": "x", "retrieval_mode": "odd"})]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in calls], "call_id string, arguments string")
    got = {r.call_id: r for r in agents.search(df, tools).collect()}
    one, two = json.loads(got["a"].result), json.loads(got["b"].result)
    assert one["n_results"] == 1 and one["retrieval_results"][0]["company"] == "adobe" and one["suggested_citations"] == [{"doc_id": one["retrieval_results"][0]["doc_id"], "page": one["retrieval_results"][0]["page_start"]}]
    assert one["retrieved_context"].startswith("[SOURCE 1]\n") and one["fiscal_year_filter"] is None
    assert two["top_k"] == 8 and two["n_results"] == 3 and two["retrieval_results"][0]["chunk_id"] == "c2" and two["retrieval_mode"] == "classical_ml"
    assert got["c"].error and got["d"].error and got["c"].result is None


def test_fact_tools_agree_with_single_calls(spark, tools):
    calls = [{}, {"company": "ADOBE"}, {"company": "adobe", "fiscal_year": 2023}, {"entity_type": "Product", "max_rows": 1}, {"company": "nobody"}]
    df = spark.createDataFrame([(str(i), json.dumps(a)) for i, a in enumerate(calls)], "call_id string, arguments string")
    got = {r.call_id: json.loads(r.result) for r in agents.lookup(df, tools.facts).collect()}
    seen = {r.call_id: json.loads(r.result) for r in agents.evidence(df, tools.facts).collect()}
    plain = lambda rows: [{k: v for k, v in r.items() if v is not None} for r in rows]
    for i, a in enumerate(calls):
        want = answering.lookup_tool(tools.facts, a.get("company"), a.get("fiscal_year"), a.get("entity_type"), a.get("max_rows", 10))
        for name, rows in want.items():
            assert plain(got[str(i)][name]) == plain([r.asDict() for r in rows.collect()]), (a, name)
        want = answering.competitor_tool(tools.facts, a.get("company"), a.get("fiscal_year"))
        assert [r["competitor_name"] for r in seen[str(i)]["summary_rows"]] == [r.competitor_name for r in want["summary"].collect()]
        assert [r["chunk_id"] for r in seen[str(i)]["evidence_rows"]] == [r.chunk_id for r in want["evidence"].collect()]


def chat(messages):
    """A toy model: what it does follows from the question and from what the tools said."""
    question, heard = messages[0]["content"], [json.loads(m["content"]) for m in messages if m["role"] == "tool"]
    if question == "fails":
        raise ValueError("model is down")
    if question == "loops":
        return {"tool_calls": [ask(agents.SEARCH, question="more")] * 2}
    if question == "plain":
        return {"text": "no JSON"}
    if not heard:
        first = [ask(agents.SEARCH, question=question, company_filter="adobe", top_k=1), ask("no_tool"), ask(agents.LOOKUP, company="adobe"), ask(agents.EVIDENCE)]
        return {"tool_calls": first}
    assert [set(h) >= {"error"} for h in heard] == [False, True, False]
    assert heard[2]["top_entities"][0]["entity_text"] == "Figma"
    return {"text": json.dumps({"answer": "Figma", "citations": [*heard[0]["suggested_citations"], {"doc_id": "made_up", "page": 1}]})}


def test_rounds(spark, tools):
    rows = [(1, "Adobe competition"), (2, "fails"), (3, "loops"), (4, "plain"), (5, "Adobe competition")]
    got = {r.query_id: r for r in agents.run(spark.createDataFrame(rows, "query_id int, query_text string"), chat, tools).collect()}
    assert len(got) == 5
    for i in (1, 5):
        trace = json.loads(got[i].tool_calls)
        assert [(t["step"], t["tool_name"], t["status"]) for t in trace] == [(1, agents.SEARCH, "success"), (2, "no_tool", "error"), (3, agents.LOOKUP, "success")]
        assert got[i].answer == "Figma" and len(got[i].citations) == 1 and got[i].citations[0].doc_id == "adobe_2022_10k"
        assert got[i].context.startswith("[SOURCE 1]") and "tool_augmented" in got[i].safety_flags and got[i].status == "success"
    assert got[2].status == "error" and got[2].error_message == "model is down" and got[2].answer == ""
    assert "max_tool_calls_reached" in got[3].safety_flags and got[3].answer.startswith(answering.REFUSAL) and len(json.loads(got[3].tool_calls)) == 3
    assert got[4].answer == "no JSON" and "non_json_agent_output" in got[4].safety_flags and got[4].tool_calls == "[]"


def test_direct_answer(spark, tools):
    rows = spark.createDataFrame([(1, "Adobe competition Figma", "adobe"), (2, None, None)], "query_id int, query_text string, company_filter string")

    def call(prompt, tokens):
        return json.dumps({"answer": "yes" if "[SOURCE 1]" in prompt else "nothing", "citations": [{"doc_id": "adobe_2022_10k", "page": 1}]})

    got = {r.query_id: r for r in agents.answer_directly(rows, tools, call).collect()}
    assert got[1].answer == "yes" and [tuple(c)[1:] for c in got[1].citations] == [("adobe_2022_10k", 1)] and got[2].answer == "nothing" and not got[2].citations
