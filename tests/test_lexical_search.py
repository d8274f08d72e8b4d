"""TF-IDF in blocks against all pairs."""

import math
import random
from collections import Counter

from lexigrove.operators import lexical_search, retrieval


def brute(chunks, queries, k):
    tfs = {c: Counter(t.split()) for c, t in chunks}
    df, n = Counter(t for tf in tfs.values() for t in tf), len(chunks)
    vector = lambda tf: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items() if t in df}
    norm = lambda v: max(math.sqrt(sum(w * w for w in v.values())), 1e-12)
    weights, out = {c: vector(tf) for c, tf in tfs.items()}, {}
    for q, text in queries:
        mine = vector(Counter(text.split()))
        scores = {c: round(sum(mine[t] * w for t, w in v.items() if t in mine) / (norm(v) * norm(mine)), 9) for c, v in weights.items()}
        out[q] = sorted(((-s, c) for c, s in scores.items()))[:k]
    return {(q, c, -s, r + 1) for q, rows in out.items() for r, (s, c) in enumerate(rows)}


def test_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHUNKS", 7)
    monkeypatch.setattr(lexical_search, "GROUP_QUERIES", 4)
    rng = random.Random(3)
    words = [f"term{chr(97 + i)}" for i in range(18)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(f"c{i:03}", said(rng.randint(0, 12))) for i in range(60)] + [(f"d{i}", "terma termb") for i in range(6)] + [("e", "")]
    queries = [(i, said(rng.randint(1, 5))) for i in range(13)] + [(90, "terma"), (91, "unknown"), (92, "")]
    rows = [(c, t, f"co{i % 3}", 2022, 1) for i, (c, t) in enumerate(chunks)]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, company string, fiscal_year int, page_start int")
    asked = spark.createDataFrame(queries, "query_id long, query_text string")
    found = retrieval.tfidf(df, asked, 5)
    # Pairs of query and chunk are cut to the best before a shuffle.
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in found.collect()}
    assert {(q, c, r) for q, c, _, r in got} == {(q, c, r) for q, c, _, r in brute(chunks, queries, 5)}

    levels = retrieval.with_levels(asked.selectExpr("*", "CASE WHEN query_id % 2 = 0 THEN 'co1' END AS company_filter"), df)
    mine = {r.query_id: r.company for r in levels.collect()}
    of = {c: co for c, _, co, _, _ in rows}
    for r in retrieval.tfidf(df, levels, 5).collect():
        assert mine[r.query_id] is None or of[r.chunk_id] == mine[r.query_id]


def test_fallback_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FALLBACK_CHUNKS", 7)
    monkeypatch.setattr(lexical_search, "GROUP_QUERIES", 3)
    rng = random.Random(4)
    words = [f"term{chr(97 + i)}" for i in range(9)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(f"c{i:03}", said(rng.randint(0, 9)), f"Co {i % 3}.", 2022 + i % 2, None if i % 11 == 0 else i % 4) for i in range(80)]
    queries = [(i, said(rng.randint(1, 5)), "co 1" if i % 2 else None, 2022 if i % 3 == 0 else None) for i in range(12)] + [(90, "unknown", None, None), (91, "", None, None)]
    df = spark.createDataFrame(chunks, "chunk_id string, chunk_text string, company string, fiscal_year int, page_start int")
    asked = spark.createDataFrame(queries, "query_id long, query_text string, company_filter string, fiscal_year_filter int")
    found = retrieval.lexical_fallback(df, asked, 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for q, text, company, year in queries:
        mine = set(text.split())
        fit = [c for c in chunks if (company is None or c[2] == "Co 1.") and (year is None or c[3] == year)]
        scored = sorted((-len(mine & set(c[1].split())) / len(mine) if mine else 0.0, c[4] is not None, c[4] or 0, c[0]) for c in fit)
        want |= {(q, c, round(-s, 9), r + 1) for r, (s, _, _, c) in enumerate(scored[:4])}
    assert {(r.query_id, r.chunk_id, round(r.lexical_score, 9), r["rank"]) for r in found.collect()} == want
