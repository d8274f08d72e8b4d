"""Items of answers by column, against the rules item by item."""

import json
import random

from pyspark.sql import functions as F

from lexigrove.functions.text import let, title_case
from lexigrove.operators import items, knowledge

SCHEMA = "chunk_id string, doc_id string, company string, fiscal_year int, page_start int, page_end int, response string"
TEXTS = [
    "Acme", "acme", "ACME Inc.", "Acme, Corp", "ΟΔΟΣ", "İstanbul", "straße", "saas", "CEO", "Adbe", "Products", "x", "ab", "John Smith", "John smith", "Élan Vital", "5 %",
    "$5 revenue", "Net Income", "net_income", "a [MENTIONS] b", "[x]", "Chief Executive Officer", "market position", "one two three four five six", "a b c d e f g h i",
    "pfizer inc", "Smith products and services", "Royal Museum", "  Acme ", "　", "\tab \u0085", "o'neil-co", "two  words.", "9th group, llc", None,
]
KINDS = ["company", "Companies", " Person ", "products", "metric", "bogus", None]
NAMES = ["competes", "COMPETITOR_OF", "offers", "led_by", "REPORTS", "mentions", "likes", None]


def answers(spark, repeat=False):
    rng, rows = random.Random(7), []
    for i in range(60):
        e = [{"entity_text": rng.choice(TEXTS), "entity_type": rng.choice(KINDS), "confidence": rng.choice([0.5, "0.7", "x", None])} for _ in range(rng.randint(0, 40))]
        t = [{"entity_a": rng.choice(TEXTS), "relation": rng.choice(NAMES), "entity_b": rng.choice(TEXTS)} for _ in range(rng.randint(0, 60))]
        said = json.dumps({"entities": e, "triplets": t})
        # A side that isn't an array of objects takes nothing from the other.
        said = {1: None, 2: "no json", 3: "{}", 4: json.dumps({"entities": ["a"], "triplets": t}), 5: json.dumps({"entities": [None, *e], "triplets": "none"})}.get(i, said)
        rows.append((f"c{i // 2 if repeat and i < 20 else i}" if i else None, f"d{i}", ["Adobe", "Pfizer Inc.", "co1", None][i % 4], 2020 + i % 3, i, i + 1, said))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_entities_keep_the_rules(spark, monkeypatch):
    monkeypatch.setattr(items, "ROWS", 7)
    df = answers(spark)
    cut = df.select("chunk_id", F.posexplode(F.from_json("response", f"entities {items.ENTITIES}")["entities"]).alias("ordinal", "x"))
    text, kind = knowledge._text(F.col("x.entity_text")), knowledge.entity_type(F.col("x.entity_type"))
    every = cut.select("chunk_id", "ordinal", text.alias("text"), kind.alias("kind"), knowledge.confidence(F.col("x.confidence")).alias("confidence"))
    want = knowledge._once(every.where(F.col("kind").isNotNull() & knowledge.is_entity(F.col("text"), F.col("kind"))).withColumn("low", F.lower("text")), ["chunk_id", "kind", "low"])
    got = knowledge.entities(df).select("chunk_id", "ordinal", F.col("entity_text").alias("text"), F.col("entity_type").alias("kind"), "confidence", F.lower("entity_text").alias("low"))
    assert got.count() > 300
    assert rows(got) == rows(want)


def test_relations_keep_the_rules(spark, monkeypatch):
    monkeypatch.setattr(items, "ROWS", 7)
    df = answers(spark)
    cut = df.select("chunk_id", F.posexplode(F.from_json("response", f"triplets {items.TRIPLETS}")["triplets"]).alias("ordinal", "x"))
    every = cut.select("chunk_id", "ordinal", knowledge._text(F.col("x.entity_a")).alias("a"), knowledge.relation(F.col("x.relation")).alias("name"), knowledge._text(F.col("x.entity_b")).alias("b"))
    good = every.where(knowledge.is_triplet(F.col("a"), F.col("name"), F.col("b"))).withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    want = knowledge._once(good, ["chunk_id", "la", "name", "lb"])
    got = knowledge.triplets(df).select("chunk_id", "ordinal", F.col("entity_a").alias("a"), F.col("relation").alias("name"), F.col("entity_b").alias("b")).withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    assert {r.name for r in got.collect()} == {"COMPETES_WITH", "OFFERS", "LEADS_BY", "REPORTS", "MENTIONS"}
    assert rows(got) == rows(want)


def test_facts_are_those_of_tables(spark, monkeypatch):
    monkeypatch.setattr(items, "ROWS", 7)
    for df in (answers(spark), answers(spark, repeat=True)):
        assert rows(knowledge.response_facts(df)) == rows(knowledge.chunk_facts(knowledge.entities(df), knowledge.triplets(df)))


def test_mentions_are_those_of_tables(spark):
    texts = [(f"c{i}", "We face competition." if i % 3 else None, i + 5, i + 6) for i in range(0, 60, 2)]
    chunks = spark.createDataFrame(texts, "chunk_id string, chunk_text string, page_start int, page_end int")
    for df in (answers(spark), answers(spark, repeat=True)):
        got = knowledge.response_mentions(df, chunks)
        assert got.count() > 100
        assert rows(got) == rows(knowledge.mentions(knowledge.entities(df), knowledge.triplets(df), chunks))


def test_items_of_one_response_pass_no_array_functions_nor_shuffles(spark):
    df, chunks = answers(spark), spark.createDataFrame([("c1", "x", 1, 1)], "chunk_id string, chunk_text string, page_start int, page_end int")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    for one in (knowledge.entities(df), knowledge.triplets(df), knowledge.response_facts(df)):
        assert "MapInArrow" in plan(one) and "transform(" not in plan(one)
    # Names are made distinct in their row: only chunks are aggregated, below the join that rows meet them in.
    seen = plan(knowledge.response_mentions(df, chunks))
    assert "Aggregate" not in seen[: seen.index("Join")]


def test_plain_names_in_title_case(spark):
    said = ["a b", "two words.", "ab.cd", "o'neil", "x1 y2", "straße ä", "(a) b", "", "a, b; c!", "co. ab", "ab\u0085", "ab .cd"]
    df = spark.createDataFrame([(s,) for s in said], "x string")

    def slow(low):
        first = lambda i: (i == 0) | ~low.substr(i, F.lit(1)).rlike(r"\p{L}")
        return F.array_join(F.transform(F.split(low, ""), lambda c, i: F.when(first(i), F.upper(c)).otherwise(c)), "")

    for r in df.select("x", title_case(F.col("x")).alias("got"), let(F.lower("x"), slow).alias("want")).collect():
        assert r.got == r.want, r.x
