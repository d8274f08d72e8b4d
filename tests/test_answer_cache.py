import json
import os
import uuid

import pytest

from lexigrove.operators.answer_cache import AnswerCache
from lexigrove.sources.versions import Versions


@pytest.fixture
def model(tmp_path):
    """A model that leaves a file for each call."""
    folder = str(tmp_path / "calls")
    os.mkdir(folder)

    def call(prompt, tokens):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(prompt)
        if prompt == "bad" and not os.path.exists(f"{folder}/../healed"):
            raise ValueError("no")
        return json.dumps({"said": prompt.upper()})

    call.seen = lambda: sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))
    return call


def test_one_call_for_each_distinct_request(spark, tmp_path, model):
    cache = AnswerCache(Versions(spark, f"file://{tmp_path}/cache"))
    rows = spark.createDataFrame([(i, ["a", "b", "bad", None][i % 4]) for i in range(40)], "id int, prompt string").repartition(5)

    def ask(df, **more):
        return {r.id: (r.response and json.loads(r.response)["said"], r.status, r.from_cache) for r in cache.ask(df, "id", "prompt", lambda p, t: model(p, t), **more).collect()}

    got = ask(rows)
    assert len(got) == 40 and got[0] == ("A", "success", False) and got[2] == (None, "error", False) and got[3] == ("", "success", False)
    assert model.seen() == ["", "a", "b", "bad"]
    # Again: only the error is asked, and a new request.
    os.mknod(tmp_path / "healed")
    more = rows.union(spark.createDataFrame([(99, "new")], "id int, prompt string"))
    got = ask(more)
    assert model.seen() == ["", "a", "b", "bad", "bad", "new"]
    assert got[0] == ("A", "success", True) and got[2] == ("BAD", "success", False) and got[99][1:] == ("success", False)
    assert all(x[2] for x in ask(more).values()) and len(model.seen()) == 6
    # Another model's answer is another request.
    assert ask(rows.where("id = 0"), model="other")[0][2] is False and len(model.seen()) == 7
    cache.compact()
    assert cache.records().count() == 6 and all(x[2] for x in ask(more).values()) and len(model.seen()) == 7


def test_empty(spark, tmp_path):
    cache = AnswerCache(Versions(spark, f"file://{tmp_path}/cache"))
    none = spark.createDataFrame([], "id int, prompt string")
    assert cache.ask(none, "id", "prompt", lambda p, t: "{}").count() == 0 and cache.records() is None


def test_few_prompts_of_a_batch_are_objects_at_once(spark, tmp_path):
    from lexigrove.operators import answering

    def call(prompt, tokens):
        if prompt.endswith("7"):
            raise ValueError("no")
        return json.dumps({"said": prompt})

    n = 3 * answering.PROMPTS + 5
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(n)], "i int, p string").coalesce(1)
    called = answering.call_rows(rows, "i", "p", call)
    plan = called._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    asked = AnswerCache(Versions(spark, f"file://{tmp_path}/c")).ask(rows, "i", "p", call)
    want = {i: (None, "error", "no") if i % 10 == 7 else (json.dumps({"said": f"p{i}"}), "success", "") for i in range(n)}
    for got in (called, asked):
        assert {r.i: (r.response, r.status, r.error_message) for r in got.collect()} == want
