"""Several modes in one go are the modes one by one, over marks that are made once."""

import random

from lexigrove.operators import retrieval


def test_modes_share_marks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"term{chr(97 + i)}" for i in range(12)] + ["risk", "competition"]
    said = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(f"c{i:02}", said(rng.randint(0, 60)), f"co{i % 3}", 2022 + i % 2, i % 5, "business" if i % 4 else "risk_factors") for i in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_text string, company string, fiscal_year int, page_start int, section_group string")
    vectors = spark.createDataFrame([(f"c{i:02}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)], "chunk_id string, embedding array<double>")
    asked = [(i, said(6), [rng.gauss(0, 1) for _ in range(8)], f"co{i}" if i < 4 else None) for i in range(6)]
    asked = spark.createDataFrame(asked, "query_id long, query_text string, embedding array<double>, company_filter string")
    names, key = ["classical_ml", "naive", "improved"], ["query_id", "chunk_id", "retrieval_mode", "final_score", "rank"]
    want = [str(r) for n in names for r in retrieval.retrieve(chunks, vectors, asked, 4, n).select(*key).collect()]
    calls = []
    monkeypatch.setattr(retrieval, "navigation", lambda text, f=retrieval.navigation: calls.append(1) or f(text))
    out = retrieval.retrieve_all(chunks, vectors, asked, 4, names)
    assert len(calls) == 1
    assert sorted(str(r) for r in out.select(*key).collect()) == sorted(want)
    assert {r.retrieval_mode for r in out.collect()} == set(names)
    assert len(want) == 6 * 4 * 3
