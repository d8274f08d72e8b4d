"""Model tables derived from the star schema and text tables, the same way in Spark and in SQL.

A document of the model is eight rows of ``documents``: its pages. Every row is also a chunk of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ["risk_factors", "business", "financial_statements", "competition", "front_matter", "market_risk", "operations"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.expr("doc_id div 8")
    group = F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (F.col("doc_id") % len(GROUPS)).cast("int") + 1)
    return read(spark, sf, "documents").select(
        F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"),
        F.concat(F.lit("d"), doc.cast("string")).alias("doc"),
        F.concat(F.lit("co"), (doc % 20).cast("string")).alias("company"),
        (F.lit(2022) + doc % 3).cast("int").alias("fiscal_year"),
        (F.col("doc_id") % 8 + 1).cast("int").alias("page_start"),
        F.col("text").alias("chunk_text"),
        group.alias("section_group"),
        F.when(F.col("doc_id") % 5 == 0, "Risk Factors").alias("section_title"),
        "doc_id",
    )


CHUNKS = f"""chunks AS (SELECT 'c' || lpad(doc_id::VARCHAR, 12, '0') AS chunk_id, 'd' || (doc_id // 8) AS doc, 'co' || ((doc_id // 8) % 20) AS company,
 (2022 + (doc_id // 8) % 3)::INT AS fiscal_year, (doc_id % 8 + 1)::INT AS page_start, text AS chunk_text,
 {GROUPS!r}[(doc_id % {len(GROUPS)})::INT + 1] AS section_group, CASE WHEN doc_id % 5 = 0 THEN 'Risk Factors' END AS section_title, doc_id FROM documents)"""


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select(
        F.col("doc").alias("doc_id"), "company", "fiscal_year", F.col("page_start").alias("page_num"), F.col("chunk_text").alias("raw_text")
    )


def dialect(sql: str) -> str:
    """Lambdas in the current spelling."""
    return re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)


# SQL fragments --------------------------------------------------------------------------------------------------


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def word_list(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\p{{Z}}]+'), w -> w <> '')"


def word_count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\s\p{{Z}}]+'))"


def stem(x: str) -> str:
    """Of a token; nested through one-element lists so that each step is written once."""
    bare = f"list_transform([lower({x})], a -> CASE WHEN a LIKE '%''s' THEN a[:-3] ELSE a END)"
    return (
        f"list_transform({bare}, b -> CASE WHEN length(b) <= 4 THEN b WHEN b LIKE '%ies' THEN b[:-4] || 'y'"
        " WHEN b LIKE '%s' AND b NOT LIKE '%ss' THEN b[:-2] ELSE b END)[1]"
    )


def terms(x: str, drop_stopwords: bool = False) -> str:
    from ..functions import values as V

    short = quoted(V.SHORT_TOKENS)
    keep = f"(length(t) >= 3 OR t IN ({short}))"
    if drop_stopwords:
        keep += f" AND (t NOT IN ({quoted(V.STOPWORDS)}) OR t IN ({short}))"
    raw = rf"regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z0-9''\-]*')"
    return f"list_filter(list_transform({raw}, x -> {stem('x')}), t -> {keep})"


EDGE = r"(?:^|[^\p{L}\p{N}_])"


def pattern(p: str) -> str:
    """A Unicode word edge for an ASCII one, where the pattern starts or ends with it."""
    if p.startswith(r"\b"):
        p = EDGE + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return p.replace("'", "''")


def found(x: str, patterns) -> str:
    return f"regexp_matches({x}, '{'|'.join('(?:' + pattern(p) + ')' for p in patterns)}')"


def hits(x: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, '{pattern(p)}')::INT" for p in patterns) + ")"
