"""Registered queries take all rows; optional limits only when asked."""

from pyspark.sql import functions as F

from lexigrove.operators import evaluation, knowledge
from lexigrove.plans import registry

LARGER = "/root/testdata/sf0.01"


def found(spark, name):
    return registry.queries()[name](spark, LARGER)


def test_all_rows_are_taken(spark):
    read = lambda t: spark.read.parquet(f"{LARGER}/{t}.parquet")
    documents, vectors = read("documents"), read("embeddings")
    with_vector = documents.join(vectors, documents.doc_id == vectors.vec_id).select("doc_id")
    assert found(spark, "join11_all_query_vectors").select("query_id").exceptAll(with_vector).isEmpty()
    assert found(spark, "join11_all_query_vectors").count() == with_vector.count()
    assert found(spark, "flt9_all_pending_questions").count() == read("benchmark").where("item_id % 3 = 1").count() > 10
    assert found(spark, "flt5_all_candidates").count() > 50


def test_candidates_are_capped_only_when_asked(spark):
    rows = [(f"c{9 - i}", "co", 2022, i, i, "revenue and products" if i % 4 else "nothing") for i in range(8)]
    df = spark.createDataFrame(rows, "chunk_id string, company string, fiscal_year int, page_start int, page_end int, chunk_text string")
    assert len(knowledge.candidates(df, "all").collect()) == 8
    every = sorted(r.page_start for r in knowledge.candidates(df, "heuristic").collect())
    assert every == [1, 2, 3, 5, 6, 7]
    assert [r.page_start for r in knowledge.candidates(df, "heuristic", most=4).collect()] == every[:4]


def test_pending_questions_are_limited_only_when_asked(spark):
    questions = spark.createDataFrame([(f"q{i}", i) for i in range(40)], "question_id string, question_order int")
    runs = spark.createDataFrame([("q1", "success"), ("q2", "error")], "question_id string, status string")
    left = [i for i in range(40) if i != 1]
    assert sorted(r.question_order for r in evaluation.pending_questions(questions, runs).collect()) == left
    assert [r.question_order for r in evaluation.pending_questions(questions, runs, limit=3).collect()] == left[:3]


def test_entity_context(spark):
    found = spark.createDataFrame([("c1", "Adobe", 9), ("c2", "Pfizer", 9)], "chunk_id string, entity_text string, page_start int")
    chunks = spark.createDataFrame([("c1", "text", 3), ("c3", "other", 4)], "chunk_id string, chunk_text string, page_start int")
    out = {tuple(r) for r in knowledge.with_context(found, chunks).select("chunk_id", "entity_text", "chunk_text", "page_start").collect()}
    assert out == {("c1", "Adobe", "text", 3), ("c2", "Pfizer", None, None)}


def test_every_entity_has_its_context(spark):
    whole = found(spark, "join4_all_entity_context")
    assert whole.where("chars IS NULL").isEmpty() and not whole.isEmpty()


def test_query_vectors_by_hash_else_by_text(spark):
    from lexigrove.functions.text import content_hash
    from lexigrove.operators.retrieval import query_vectors

    asked = spark.createDataFrame([(1, "a"), (2, "b "), (3, "c"), (4, None), (5, "a")], "query_id int, query_text string")
    cache = spark.createDataFrame([("h", "a", [1.0]), ("x2", "b ", [2.0]), ("x3", "b ", [3.0]), ("x4", "b", [4.0])], "query_id string, query_text string, embedding array<double>")
    by_hash = cache.where("query_id = 'h'").withColumn("query_id", content_hash(F.col("query_text")))
    out = query_vectors(asked, by_hash.unionByName(cache.where("query_id <> 'h'")))
    assert out.columns == ["query_id", "query_text", "embedding"]
    assert {(r.query_id, r.query_text, r.embedding[0]) for r in out.collect()} == {(1, "a", 1.0), (5, "a", 1.0), (2, "b ", 3.0)}
