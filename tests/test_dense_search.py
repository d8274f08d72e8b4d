import numpy as np
import pytest

from lexigrove.operators import dense_search, retrieval

CHUNKS = "vec_id long, embedding array<float>, company string, fiscal_year int, uploaded boolean, noisy boolean"
QUERIES = "query_id long, embedding array<float>, company string, year int, drop_noise boolean"


def clustered(rng, n, dim=8, centers=12):
    middle = rng.normal(size=(centers, dim))
    return (middle[rng.integers(centers, size=n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(chunks, queries, k, filtered):
    unit = lambda v: v / (np.linalg.norm(v) or 1.0)
    out = set()
    for q, vector, company, year, drop in queries:
        if vector is None:
            continue
        rows = []
        for key, other, c, y, up, noisy in chunks:
            if key is None or other is None:
                continue
            fits = not filtered or ((company is None or c == company or up) and (year is None or y == year or up) and not (drop and noisy))
            if fits:
                rows.append((-round(float(unit(np.array(vector, float)) @ unit(np.array(other, float))), 9) + 0.0, key))
        out |= {(q, key, -s + 0.0, i) for i, (s, key) in enumerate(sorted(rows)[:k], 1)}
    return out


def tables(rng, n=600, m=60):
    vectors = clustered(rng, n)
    vectors[: n // 3] = vectors[0]  # one vector in a third of all rows
    vectors[5] = 0
    chunks = [(i, v.tolist(), f"co{i % 3}", 2020 + i % 2, i % 50 == 0, i % 7 == 0) for i, v in enumerate(vectors)]
    chunks += [(None, vectors[1].tolist(), None, None, False, False), (n, None, None, None, False, False), (n + 1, vectors[9].tolist(), None, None, None, None)]
    asked = clustered(rng, m)
    asked[0] = 0
    queries = [(i, v.tolist(), [None, "co1", "nobody"][i % 3], [None, 2021][i % 2], i % 4 == 0) for i, v in enumerate(asked)] + [(m, None, None, None, False)]
    return chunks, queries


@pytest.mark.parametrize("filtered", [False, True])
@pytest.mark.parametrize("piece_rows", [10**6, 40])
def test_against_all_pairs(spark, filtered, piece_rows):
    chunks, queries = tables(np.random.default_rng(piece_rows % 97))
    c, q = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, QUERIES)
    placed = dense_search.place(c, "vec_id", filtered, piece_rows)
    found, report = dense_search.search(placed, q, 7, task_queries=20)
    got = {(r.query_id, r.vec_id, r.score + 0.0, r["rank"]) for r in found.collect()}
    want = brute(chunks, queries, 7, filtered)
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    assert {(a, b): s for a, b, s, _ in got} == pytest.approx({(a, b): s for a, b, s, _ in want}, abs=1.1e-9)
    assert all(0 < r.visited <= r.pieces for r in report.collect())


def test_pieces_are_skipped(spark):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 4000, centers=40)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:200])], "query_id long, embedding array<float>")
    found, report = dense_search.search(dense_search.place(c, "vec_id", False, 100), q, 5)
    visited, pieces = report.selectExpr("sum(visited)", "sum(pieces)").first()
    assert visited < 0.3 * pieces
    assert {(r.query_id, r["rank"]) for r in found.where("rank = 1").collect()} == {(i, 1) for i in range(200)}


def test_plan_does_not_grow_with_the_queries(spark):
    rng = np.random.default_rng(4)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, 300))], "vec_id long, embedding array<float>")

    def size(n):
        q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(rng, n))], "query_id long, embedding array<float>")
        found, _ = dense_search.search(dense_search.place(c, "vec_id", False, 50), q, 3)
        return found._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(5) == size(3000)


def test_empty(spark):
    chunks, queries = tables(np.random.default_rng(5), 20, 4)
    c, q = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, QUERIES)
    assert retrieval.dense(c.limit(0), q, 3, "vec_id").count() == 0
    assert retrieval.dense(c, q.limit(0), 3, "vec_id").count() == 0
    assert retrieval.dense(c, q, 3, "vec_id").columns == ["query_id", "vec_id", "score", "rank"]
    with pytest.raises(Exception, match="vectors differ in length"):
        bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
        retrieval.dense(bad.coalesce(1), q.select("query_id", "embedding"), 3, "vec_id").collect()
