"""Facts come from the arrays of a response; only chunks with several responses are shuffled."""

import json

from pyspark.sql import functions as F

from lexigrove.operators import knowledge
from lexigrove.operators.answering import extract

SCHEMA = "chunk_id string, doc_id string, company string, fiscal_year int, page_start int, page_end int, response string"


def answers(spark, ids):
    def said(i):
        names = [{"entity_text": t, "entity_type": k, "confidence": 0.5} for t, k in ((f"Acme {i}", "company"), ("acme", "company"), ("ACME", "executive"), ("Acme", "company"))]
        related = [{"entity_a": "Acme", "relation": r, "entity_b": b} for r, b in (("COMPETES_WITH", f"Beta {i}"), ("COMPETES_WITH", "beta Inc."), ("MENTIONS", f"Beta {i}"), ("COMPETES_WITH", "Beta Inc."))]
        return json.dumps({"entities": names, "triplets": related})

    rows = [(c, "d", "co", 2022, n, n, said(i)) for n, (c, i) in enumerate(ids)]
    rows += [("none", "d", "co", 2022, 1, 1, "{}"), ("bad", "d", "co", 2022, 1, 1, "no json")]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_with_one_response_are_not_aggregated(spark):
    rows = answers(spark, [("a", 1), ("b", 2), (None, 3)])
    for df in (knowledge.entities(rows), knowledge.triplets(rows), knowledge.response_facts(rows)):
        assert "Aggregate" not in plan(df) and "Join" not in plan(df)


def test_facts_of_responses_are_those_of_tables(spark):
    for ids in ([("a", 1), ("b", 2)], [("a", 1), ("a", 2), ("a", 1), ("b", 3), (None, 4), (None, 4)]):
        rows = answers(spark, ids)
        found, related = knowledge.entities(rows), knowledge.triplets(rows)
        for df, key in ((found, ["entity_type", F.lower("entity_text")]), (related, ["relation", F.lower("entity_a"), F.lower("entity_b")])):
            assert df.count() == df.select("chunk_id", *key).distinct().count() > 0
        want = {tuple(r) for r in knowledge.chunk_facts(found, related).select(F.struct("*").cast("string")).collect()}
        assert {tuple(r) for r in knowledge.response_facts(rows).select(F.struct("*").cast("string")).collect()} == want


def test_no_text_beside_each_entity(spark):
    rows = answers(spark, [("a", 1), ("b", 2)])
    chunks = spark.createDataFrame([("a", "We face competition from rivals.", 1, 1), ("b", None, 2, 2)], "chunk_id string, chunk_text string, page_start int, page_end int")
    seen = knowledge.mentions(knowledge.entities(rows), knowledge.triplets(rows), chunks)
    joins = [line for line in plan(seen).splitlines() if "Join" in line]
    assert joins
    assert {(r.chunk_id, r.has_competition_risk_signal) for r in seen.where("mention_source = 'entity'").collect()} == {("a", True), ("b", False)}
    above = plan(seen)[: plan(seen).index("Join")]
    assert "chunk_text" not in above


def test_a_model_is_called_once_a_chunk(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "d", "co", 2022, 1, 1, f"Acme{i}") for i in range(6)], SCHEMA.replace("response", "chunk_text"))
    folder = str(tmp_path)

    def call(prompt, tokens):
        import json
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return json.dumps({"entities": [{"entity_text": prompt.split()[-1], "entity_type": "company"}]})

    found, checkpoint = extract(chunks, call)
    assert found.count() == 6 and checkpoint.where("record_count = 1 AND status = 'success'").count() == 6
    assert len(list(tmp_path.iterdir())) == 6
