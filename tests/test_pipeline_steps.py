import json
import os
import uuid

import pytest

from lexigrove.operators import answering
from lexigrove.plans import pipeline as P


@pytest.fixture
def run(spark, tmp_path):
    words = "Adobe faces competition from other vendors and reports revenue growth in its segments. " * 12
    pages = spark.createDataFrame(
        [("a", "adobe", 2022, i, "Item 1A. Risk Factors\n" + words if i == 1 else words) for i in range(1, 4)] + [("p", "pfizer", 2023, 1, words.replace("Adobe", "Pfizer"))],
        "doc_id string, company string, fiscal_year int, page_num int, raw_text string",
    )
    questions = spark.createDataFrame([("q1", "How does Adobe compete?", "adobe", 0), ("q2", "Pfizer revenue?", None, 1)], "question_id string, question string, company_filter string, question_order int")
    calls = str(tmp_path / "calls")
    os.mkdir(calls)

    def call(prompt, tokens):
        if "Pfizer revenue?" in prompt and not os.path.exists(f"{calls}/../healed"):
            raise ValueError("down")
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as file:
            file.write(prompt[:40])
        if prompt.startswith("Extract entities"):
            return json.dumps({"entities": [{"entity_text": "Figma", "entity_type": "company", "confidence": 1}]})
        if prompt.startswith("Extract triplets"):
            return json.dumps({"triplets": [{"entity_a": "Adobe", "relation": "COMPETES_WITH", "entity_b": "Figma"}]})
        return json.dumps({"verdict": "Yes"} if "supported by the context" in prompt else {"answer": "by products", "citations": [{"doc_id": "a", "page": 1}]})

    out = P.Run(spark, f"file://{tmp_path}/run", {"pages": (pages, "v1"), "questions": (questions, "v1")}, answering.hash_encoder(), call)
    out.calls = lambda: len(os.listdir(calls))
    out.heal = lambda: os.mknod(f"{calls}/../healed")
    return out


def test_a_run_end_to_end_and_again(spark, run):
    graph = P.steps("token", 2, size=120, overlap=20, least=20)
    done = P.execute(run, graph)
    assert set(done.values()) == {"ran"} and len(done) == 17
    metrics = {r.retrieval_mode: r for r in run.table("metrics").read().collect()}
    assert set(metrics) == set(P.COMPARED) and all(m.total_questions == 2 and m.number_of_yes == 1 for m in metrics.values())
    assert run.table("answers_naive").read().where("status = 'error'").count() == 1
    asked = run.calls()
    # Again: only steps with errors and those after them, and no call that was answered.
    done = P.execute(run, graph)
    assert done["chunks"] == done["facts"] == done["retrieved_naive"] == "current" and done["answers_naive"] == "ran" and run.calls() == asked
    # The model is back: three answers and their verdicts are asked, and nothing else.
    run.heal()
    done = P.execute(run, graph)
    assert {r.number_of_yes for r in run.table("metrics").read().collect()} == {2} and asked < run.calls() <= asked + 6
    asked = run.calls()
    assert set(P.execute(run, graph).values()) == {"current"} and run.calls() == asked
    # Another option, or another input, is another signature.
    known = {"chunks": "x", "vectors": "y", "question_set": "z"}
    signed = {k: run.signature(next(s for s in P.steps("token", k) if s.name == "retrieved_naive"), known) for k in (1, 2)}
    assert signed[1] != signed[2] != run.signature(graph[7], known | {"chunks": "other"})


def test_a_killed_run_repeats_one_step(spark, run, monkeypatch):
    graph = P.steps("token", 2, size=120, overlap=20, least=20)[:7]

    def die(t, r):
        raise KeyboardInterrupt

    broken = [P.Step(s.name, s.phase, s.inputs, die, s.options) if s.name == "triplet_answers" else s for s in graph]
    with pytest.raises(KeyboardInterrupt):
        P.execute(run, broken)
    done = P.execute(run, graph)
    assert [n for n, what in done.items() if what == "ran"] == ["triplet_answers", "facts", "question_set"]
    # Later phases alone, from what is there; a missing table is named.
    assert P.execute(run, [s for s in graph if s.name == "facts"]) == {"facts": "current"}
    with pytest.raises(FileNotFoundError, match="judged_classical_ml"):
        P.execute(run, P.steps()[-1:])
    log = [(r.step, r.status) for r in run.table("log").read().collect()]
    assert ("chunks", "success") in log and ("triplet_answers", "killed") in log and ("triplet_answers", "success") in log
