"""Postings are counted in their row; norms shuffle only what rare terms have."""

import random

from pyspark.sql import functions as F

from lexigrove.operators import postings_store, query_terms, retrieval


def corpus(spark, repeat=()):
    rng = random.Random(9)
    words = ["The", "risks", "risk's", "companies", "gas", "class", "AI", "ai", "U.S.", "x1", "co-op", "boss's", "Zürich", "of", "eps"] + [f"word{i}s" for i in range(60)]
    rows = [(f"c{i}", " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(70)] + [("n", None), ("e", ""), (None, "risk")]
    rows += [(f"c{i}", f"risk again{i}") for i in repeat]
    return spark.createDataFrame(rows, "chunk_id string, chunk_text string").withColumns({"company": F.lit("co"), "fiscal_year": F.lit(2022), "page_start": F.lit(1)})


def test_postings_are_those_of_sql(spark, monkeypatch):
    monkeypatch.setattr(query_terms, "ROWS", 8)
    for df in (corpus(spark), corpus(spark, repeat=(3, 3, 5))):
        want = retrieval.postings(df, ["chunk_id"], F.col("chunk_text"), True)
        got = postings_store._cut(df)
        assert want.count() > 1000
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_a_text_is_counted_without_a_shuffle(spark):
    plan = postings_store._cut(corpus(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_norms_of_frequent_and_rare_terms(spark, monkeypatch):
    df = corpus(spark).where("chunk_id IS NOT NULL")
    index = postings_store.of_chunks(df)
    got = []
    for hot in (1, 30, 10**9):
        monkeypatch.setattr(postings_store, "HOT_TERMS", hot)
        got.append({r.chunk_id: round(r.norm, 9) for r in postings_store.norms(index.postings, index.df, 72).collect()})
    w = index.postings.join(retrieval.idf(index.df, 72), "term").select("chunk_id", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    want = {r.chunk_id: round(r.n, 9) for r in w.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n")).collect()}
    assert len(want) > 60 and all(g == want for g in got)
