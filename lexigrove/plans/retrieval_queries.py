"""Retrieval queries. Query sets: every row whose id is divisible by 100, or all benchmark items, against all rows."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sections
from ..functions import values as V
from ..functions.text import coverage, terms
from ..operators import answering, evaluation, postings_store, retrieval
from ..sources.scratch import shared_folder
from ..sources.versions import Versions
from . import model as M

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = M.dialect(sql)
        return fn

    return add


# Dense -----------------------------------------------------------------------------------------------------------

_dot = lambda a, b: f"list_sum(list_transform(range(len({a})), i -> {a}[i::INT + 1]::DOUBLE * {b}[i::INT + 1]::DOUBLE))"
_cos = f"round({_dot('q.embedding', 'c.embedding')} / (sqrt({_dot('q.embedding', 'q.embedding')}) * sqrt({_dot('c.embedding', 'c.embedding')})), 9)"


@query(
    "top1_dense",
    f"""SELECT query_id, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, c.vec_id, {_cos} AS score FROM embeddings q CROSS JOIN embeddings c WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
)
def top1(spark, sf):
    vectors = M.read(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(vectors.select("vec_id", "embedding"), asked, 10, "vec_id")


@query("scr1_cosine", f"SELECT c.vec_id, {_cos} AS score FROM embeddings c CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def scr1(spark, sf):
    vectors = M.read(spark, sf, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return vectors.join(F.broadcast(one)).select("vec_id", F.round(retrieval.cosine(F.col("q"), F.col("embedding")), 9).alias("score"))


@query(
    "join1_index",
    f"WITH {M.CHUNKS} SELECT chunk_id, company, fiscal_year, len(embedding)::INT AS size FROM chunks JOIN embeddings ON vec_id = doc_id",
)
def join1(spark, sf):
    return _index(spark, sf).select("chunk_id", "company", "fiscal_year", F.size("embedding").alias("size"))


@query("join11_all_query_vectors", "SELECT doc_id AS query_id, embedding[1]::DOUBLE AS first FROM documents JOIN embeddings ON vec_id = doc_id")
def join11_all(spark, sf):
    from ..functions.text import content_hash

    docs = M.read(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" #"), "doc_id").alias("query_text"))
    vectors = M.read(spark, sf, "embeddings")
    found = docs.join(vectors, docs.doc_id == F.col("vec_id"))
    # Half of the cache is keyed by the hash of the text, half by another id.
    key = F.when(F.col("doc_id") % 2 == 0, content_hash(F.col("query_text"))).otherwise(F.concat(F.lit("x"), "doc_id"))
    asked = docs.select(F.col("doc_id").alias("query_id"), "query_text")
    out = retrieval.query_vectors(asked, found.select(key.alias("query_id"), "query_text", "embedding"))
    return out.select("query_id", F.col("embedding")[0].cast("double").alias("first"))


# Lexical ---------------------------------------------------------------------------------------------------------


def _stored(spark, sf):
    """The index of all chunks, in the session's shared folder: built by the first query that asks for it, while ``documents`` is as it was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(path)
    found = files.listStatus(path) if status.isDirectory() else [status]
    signature = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found)
    name = hashlib.sha256(json.dumps([spark.sparkContext.applicationId, signature]).encode()).hexdigest()
    store = Versions(spark, f"{shared_folder(spark)}/index-{name}")
    if not store.current()[0]:
        postings_store.add(store, M.chunks(spark, sf))
        postings_store.with_norms(store)
        target = spark._jvm.org.apache.hadoop.fs.Path(store.root)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return postings_store.open_store(store)


def _asked(spark, sf):
    return M.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


_doc_terms = f"{M.CHUNKS}, doc_terms AS (SELECT chunk_id, unnest({M.terms('chunk_text', True)}) AS term FROM chunks)"


@query("agg14_document_frequency", f"WITH {_doc_terms} SELECT term, count(DISTINCT chunk_id)::BIGINT AS df FROM doc_terms GROUP BY term")
def agg14(spark, sf):
    return _stored(spark, sf).df


_tfidf = f"""WITH {_doc_terms}, post AS (SELECT chunk_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL), n AS (SELECT count(*) AS n FROM chunks),
 idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM post, n GROUP BY term, n), dw AS (SELECT chunk_id, term, (1.0 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)),
 dn AS (SELECT chunk_id, greatest(sqrt(sum(w * w)), 1e-12) AS norm FROM dw GROUP BY chunk_id), qt AS (SELECT item_id AS query_id, unnest({M.terms('text', True)}) AS term FROM benchmark),
 qp AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL), qw AS (SELECT query_id, term, (1.0 + ln(tf)) * idf AS w FROM qp JOIN idf USING (term)),
 qn AS (SELECT query_id, greatest(sqrt(sum(w * w)), 1e-12) AS norm FROM qw GROUP BY query_id), dot AS (SELECT query_id, chunk_id, sum(dw.w * qw.w) AS d FROM dw JOIN qw USING (term) GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, round(d / (dn.norm * qn.norm), 9) AS score FROM dot JOIN dn USING (chunk_id) JOIN qn USING (query_id))
 SELECT query_id, chunk_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 5"""


@query("top2_tfidf", _tfidf)
def top2(spark, sf):
    return retrieval.tfidf(_stored(spark, sf), _asked(spark, sf), 5)


@query(
    "top4_lexical_fallback",
    f"""WITH {M.CHUNKS}, d AS (SELECT DISTINCT chunk_id, page_start, unnest({M.terms('chunk_text')}) AS term FROM chunks), q AS (SELECT DISTINCT item_id AS query_id, unnest({M.terms('text', True)}) AS term FROM benchmark),
 n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), f AS (SELECT query_id, chunk_id, page_start, count(*) / any_value(n)::DOUBLE AS lexical_score FROM d JOIN q USING (term) JOIN n USING (query_id) GROUP BY ALL),
 s AS (SELECT *, round(0.65 * lexical_score + 0.35 * lexical_score, 9) AS final_score FROM f)
 SELECT query_id, chunk_id, lexical_score, final_score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, lexical_score DESC, page_start, chunk_id) AS r FROM s) WHERE r <= 5""",
)
def top4(spark, sf):
    return retrieval.lexical_fallback(_stored(spark, sf), _asked(spark, sf), 5).select("query_id", "chunk_id", "lexical_score", "final_score", "rank")


# Filters, features, hybrid -----------------------------------------------------------------------------------------


@query(
    "flt3_inferred_filters",
    r"""SELECT doc_id, CASE WHEN lower(q) LIKE '%adobe%' THEN 'adobe' WHEN lower(q) LIKE '%lockheed martin%' THEN 'lockheedmartin' WHEN lower(q) LIKE '%lockheedmartin%' THEN 'lockheedmartin' WHEN lower(q) LIKE '%pfizer%' THEN 'pfizer' END AS company,
 try_cast(regexp_extract(q, '(?:^|[^\p{L}\p{N}_])(2022|2023|2024)(?:$|[^\p{L}\p{N}_])', 1) AS INT) AS year FROM (SELECT doc_id, ['Adobe ', '', 'LockheedMartin x', 'Pfizer, '][doc_id % 4 + 1] || text || ' ' || (2020 + doc_id % 6) || '.' AS q FROM documents)""",
)
def flt3(spark, sf):
    i = F.col("doc_id")
    name = F.element_at(F.array(F.lit("Adobe "), F.lit(""), F.lit("LockheedMartin x"), F.lit("Pfizer, ")), (i % 4).cast("int") + 1)
    said = F.concat(name, "text", F.lit(" "), (i % 6 + 2020).cast("string"), F.lit("."))
    return M.read(spark, sf, "documents").select("doc_id", retrieval.inferred_company(said).alias("company"), retrieval.inferred_year(said).alias("year"))


def _search(spark, sf):
    """Queries of every hundredth vector with filters that fit some, one or no chunk."""
    docs = M.chunks(spark, sf).select("doc_id", "chunk_text")
    i = F.col("vec_id")
    asked = M.read(spark, sf, "embeddings").where("vec_id % 100 = 0").join(docs, i == docs.doc_id)
    company = F.when(i % 300 == 0, F.concat(F.lit("co"), (F.expr("vec_id div 8") % 20).cast("string"))).when(i % 300 == 100, "nobody")
    return asked.select(i.alias("query_id"), F.concat(F.lit("What are the risk factors? "), "chunk_text").alias("query_text"), "embedding", company.alias("company_filter"))


def _index(spark, sf):
    vectors = M.read(spark, sf, "embeddings").select(F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("chunk_id"), "embedding")
    return retrieval.index(M.chunks(spark, sf), vectors)




def _sql_base(embedded: bool = True) -> str:
    """Candidates and levels of the queries that have a vector: chunks with a vector, or all (classical retrieval needs none)."""
    from .text_queries import _lines as lines
    from .text_queries import _nav as nav

    return f"""{M.CHUNKS}, lined AS (SELECT *, {lines} AS h, {M.word_count("coalesce(chunk_text, '')")} AS nw FROM chunks {"JOIN" if embedded else "LEFT JOIN"} embeddings ON vec_id = doc_id),
 cand AS (SELECT *, len(h) = 0 OR (nw < 40 AND {nav} = len(h)) OR (nw < 80 AND {nav} / greatest(1, len(h)) >= 0.7) AS noisy FROM lined),
 q AS (SELECT vec_id AS query_id, embedding, 'What are the risk factors? ' || chunk_text AS query_text, CASE WHEN vec_id % 300 = 0 THEN 'co' || ((vec_id // 8) % 20) WHEN vec_id % 300 = 100 THEN 'nobody' END AS company_filter,
 try_cast(regexp_extract('What are the risk factors? ' || chunk_text, '(?:^|[^\\p{{L}}\\p{{N}}_])(2022|2023|2024)(?:$|[^\\p{{L}}\\p{{N}}_])', 1) AS INT) AS y FROM cand WHERE vec_id % 100 = 0),
 m AS (SELECT query_id, chunk_id, CASE WHEN NOT noisy AND (company_filter IS NULL OR company = company_filter) AND (y IS NULL OR fiscal_year = y) THEN 3 WHEN NOT noisy AND (company_filter IS NULL OR company = company_filter) THEN 2 ELSE 1 END AS lvl FROM q CROSS JOIN cand),
 kept AS (SELECT query_id, chunk_id, lvl, max(lvl) OVER (PARTITION BY query_id) AS top FROM m QUALIFY lvl >= max(lvl) OVER (PARTITION BY query_id))"""


_filtered = f"""WITH {_sql_base(embedded=False)}, doc_terms AS (SELECT chunk_id, unnest({M.terms('chunk_text', True)}) AS term FROM chunks), post AS (SELECT chunk_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL), n AS (SELECT count(*) AS n FROM chunks),
 idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf FROM post, n GROUP BY term, n), dw AS (SELECT chunk_id, term, (1.0 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)),
 dn AS (SELECT chunk_id, greatest(sqrt(sum(w * w)), 1e-12) AS norm FROM dw GROUP BY chunk_id), qt AS (SELECT query_id, unnest({M.terms('query_text', True)}) AS term FROM q),
 qp AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL), qw AS (SELECT query_id, term, (1.0 + ln(tf)) * idf AS w FROM qp JOIN idf USING (term)),
 qn AS (SELECT query_id, greatest(sqrt(sum(w * w)), 1e-12) AS norm FROM qw GROUP BY query_id), dots AS (SELECT query_id, chunk_id, sum(dw.w * qw.w) AS d FROM dw JOIN qw USING (term) GROUP BY ALL),
 s AS (SELECT query_id, chunk_id, round(coalesce(d / (dn.norm * qn.norm), 0), 9) AS score FROM kept LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN dn USING (chunk_id) LEFT JOIN qn USING (query_id))
 SELECT query_id, chunk_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 5"""


@query("top2_filtered", _filtered)
def top2_filtered(spark, sf):
    """Classical retrieval under company, year and noise filters of each fallback level."""
    index = _stored(spark, sf)
    return retrieval.tfidf(index, retrieval.with_levels(_search(spark, sf), index.chunks), 5)


@query("flt2_mask_levels", f"WITH {_sql_base()} SELECT query_id, (4 - any_value(top))::INT AS level, count(*)::BIGINT AS n_candidates FROM kept GROUP BY query_id")
def flt2(spark, sf):
    return retrieval.with_levels(_search(spark, sf), _index(spark, sf)).select("query_id", "level", "n_candidates")


def _features(spark, sf):
    docs = M.chunks(spark, sf)
    said = F.element_at(F.array(*[F.lit(s) for s in _SAID]), (F.col("doc_id") % len(_SAID)).cast("int") + 1)
    return docs.withColumn("said", said).withColumn("asked", retrieval.intents(F.col("said")))


_SAID = ["What are the main risk factors and competition?", "Revenue and EPS margin", "Which products in the AI segment?", "Who leads?", "generative AI, market position and services"]
_said_sql = f"[{M.quoted(_SAID)}][doc_id % {len(_SAID)} + 1]"


def _intents_sql(x: str) -> str:
    parts = []
    for name, needles in V.INTENTS.items():
        tests = [f"{x} LIKE '%{n}%'" for n in needles] + ([f"' ' || {x} || ' ' LIKE '% ai %'"] if name == "ai" else [])
        parts.append(f"CASE WHEN {' OR '.join(tests)} THEN '{name}' END")
    return f"list_filter([{', '.join(parts)}], n -> n IS NOT NULL)"


_feat = f"{M.CHUNKS}, feat AS (SELECT *, {_said_sql} AS said, {_intents_sql('lower(' + _said_sql + ')')} AS asked FROM chunks)"


def _weights_sql(table) -> str:
    rows = [f"CASE WHEN list_contains(asked, '{i}') AND section_group = '{g}' THEN {w} ELSE 0 END" for i, row in table.items() for g, w in row.items()]
    return f"greatest({', '.join(rows)})"


@query("scr7_intents", f"WITH {_feat} SELECT chunk_id, array_to_string(asked, ',') AS intents FROM feat")
def scr7(spark, sf):
    return _features(spark, sf).select("chunk_id", F.array_join("asked", ",").alias("intents"))


@query("scr4_coverage", f"WITH {_feat}, t AS (SELECT chunk_id, list_distinct({M.terms('said', True)}) AS q, list_distinct({M.terms('chunk_text')}) AS d FROM feat) SELECT chunk_id, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, d)) / len(q)::DOUBLE END::DOUBLE AS coverage FROM t")
def scr4(spark, sf):
    return _features(spark, sf).select("chunk_id", coverage(terms(F.col("said"), True), terms(F.col("chunk_text"))).alias("coverage"))


_digits = r"length(regexp_replace(chunk_text, '\P{Nd}', '', 'g'))"
_letters = r"length(regexp_replace(chunk_text, '\P{L}', '', 'g'))"


@query(
    "scr6_numeric_penalty",
    f"""WITH {_feat}, d AS (SELECT *, {_digits} AS g, {_letters} AS l FROM feat), p AS (SELECT *, CASE WHEN g / greatest(1, g + l)::DOUBLE > 0.18 THEN least(0.35, (g / (g + l)::DOUBLE - 0.18) * 1.5) ELSE 0 END AS p FROM d)
 SELECT chunk_id, CASE WHEN list_contains(asked, 'financial_metrics') OR g = 0 THEN 0 ELSE least(0.6, CASE WHEN section_group = 'financial_statements' THEN greatest(p, 0.35) ELSE p END) END::DOUBLE AS penalty FROM p""",
)
def scr6(spark, sf):
    return _features(spark, sf).select("chunk_id", retrieval.numeric_penalty(F.col("asked"), F.col("chunk_text"), F.col("section_group")).alias("penalty"))


@query("sec7_section_weights", f"WITH {_feat} SELECT chunk_id, {_weights_sql(V.WANTED)}::DOUBLE AS wanted, {_weights_sql(V.UNWANTED)}::DOUBLE AS unwanted FROM feat")
def sec7(spark, sf):
    g = F.col("section_group")
    return _features(spark, sf).select("chunk_id", sections.weight(F.col("asked"), g, V.WANTED).alias("wanted"), retrieval.section_penalty(F.col("asked"), g).alias("unwanted"))


def _prior_sql(text: str) -> str:
    shares = [f"CASE WHEN list_contains(asked, '{i}') THEN {M.hits(text, ps)} / {len(ps)}.0::DOUBLE ELSE 0 END" for i, ps in V.INTENT_PATTERNS.items()]
    return f"greatest({', '.join(shares)}, {_weights_sql(V.WANTED)})::DOUBLE"


@query("scr8_section_prior", f"WITH {_feat} SELECT chunk_id, CASE WHEN trim(chunk_text) = '' THEN 0.0 ELSE {_prior_sql('lower(chunk_text)')} END AS prior FROM feat")
def scr8(spark, sf):
    return _features(spark, sf).select("chunk_id", retrieval.section_score(F.col("asked"), F.col("chunk_text"), F.col("section_group")).alias("prior"))


@query(
    "scr9_relation_score",
    f"""WITH {_feat}, r AS (SELECT *, ['COMPETES_WITH', 'offers ', 'REPORTS', 'LEADS_BY', 'FACES_RISK_FROM', 'MENTIONS'][doc_id % 6 + 1] AS rel FROM feat)
 SELECT chunk_id, greatest(CASE WHEN rel = 'COMPETES_WITH' AND list_contains(asked, 'competition') THEN 1.0 ELSE 0 END, CASE WHEN rel = 'REPORTS' AND list_contains(asked, 'financial_metrics') THEN 1.0 ELSE 0 END,
 CASE WHEN rel = 'FACES_RISK_FROM' AND list_contains(asked, 'risk_factors') THEN 1.0 ELSE 0 END, CASE WHEN rel = 'offers ' AND regexp_matches(lower(said), 'offer|product|platform|service') THEN 0.85 ELSE 0 END,
 CASE WHEN rel = 'LEADS_BY' AND regexp_matches(lower(said), 'ceo|chief executive|lead|led by|executive') THEN 0.85 ELSE 0 END, CASE WHEN rel = 'MENTIONS' AND lower(said) LIKE '%mention%' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM r""",
)
def scr9(spark, sf):
    names = F.array(*[F.lit(r) for r in ("COMPETES_WITH", "offers ", "REPORTS", "LEADS_BY", "FACES_RISK_FROM", "MENTIONS")])
    one = F.array(F.element_at(names, (F.col("doc_id") % 6).cast("int") + 1))
    return _features(spark, sf).select("chunk_id", retrieval.relation_score(F.col("said"), F.col("asked"), one).alias("score"))


_header_text = f"concat_ws(chr(10), nullif(section_title, ''), array_to_string(list_filter(list_transform(regexp_split_to_array(chunk_text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), l -> trim(l)), l -> l <> '')[:6], chr(10)))"


@query(
    "scr5_header_score",
    f"WITH {_feat}, t AS (SELECT chunk_id, list_distinct({M.terms('said', True)}) AS q, list_distinct({M.terms(_header_text)}) AS d FROM feat) SELECT chunk_id, (len(list_intersect(q, d)) / len(q)::DOUBLE)::DOUBLE AS score FROM t",
)
def scr5(spark, sf):
    return _features(spark, sf).select("chunk_id", retrieval.header_score(terms(F.col("said"), True), F.col("chunk_text"), F.col("section_title")).alias("score"))


def _norm(x: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"(CASE WHEN abs(max({x}) {w} - min({x}) {w}) <= 1e-8 + 1e-5 * abs(min({x}) {w}) THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END ELSE ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END)"


_dense_pool, _second_pool = retrieval.pools(5)
_bm25 = f"""doc_words AS (SELECT query_id, chunk_id, {M.terms("coalesce(section_title, '') || chr(10) || chunk_text")} AS w FROM pool), sized AS (SELECT query_id, chunk_id, w, len(w) AS dl FROM doc_words),
 st AS (SELECT query_id, count(*) AS n, greatest(avg(dl), 1.0) AS av FROM sized GROUP BY query_id), qterm AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({M.terms('query_text', True)}) AS term FROM q) GROUP BY ALL),
 dterm AS (SELECT query_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT query_id, chunk_id, dl, unnest(w) AS term FROM sized) GROUP BY ALL), hit AS (SELECT * FROM dterm JOIN qterm USING (query_id, term)),
 dfs AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
 bm AS (SELECT query_id, chunk_id, sum(qtf * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS bm25_score FROM hit JOIN dfs USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL)"""
def _hybrid_sql(facts: str = "", known: str = "0") -> str:
    """The staged ranking; ``known`` is SQL of a knowledge score between 0 and 1 over the columns of a CTE in ``facts``."""
    return f"""WITH {_sql_base()}, {facts}near AS (SELECT * FROM (SELECT k.query_id, c.chunk_id, {_cos} AS score FROM kept k JOIN q USING (query_id) JOIN cand c USING (chunk_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {_dense_pool}),
 pool AS (SELECT query_id, chunk_id, score, chunk_text, section_title, section_group, doc_id, query_text, {_intents_sql('lower(query_text)')} AS asked FROM near JOIN cand USING (chunk_id) JOIN q USING (query_id)), {_bm25},
 cov AS (SELECT *, coalesce(bm25_score, 0) AS bm, list_distinct({M.terms('query_text', True)}) AS qt FROM pool LEFT JOIN bm USING (query_id, chunk_id)),
 f1 AS (SELECT *, len(list_intersect(qt, list_distinct({M.terms('chunk_text')}))) / len(qt)::DOUBLE AS coverage, {known} AS know FROM cov),
 f2 AS (SELECT *, round(0.55 * {_norm('score')} + 0.30 * {_norm('bm')} + 0.15 * coverage + 0.08 * know, 9) AS preliminary FROM f1),
 f3 AS (SELECT * FROM f2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY preliminary DESC, chunk_id) <= {_second_pool}),
 f4 AS (SELECT *, CASE WHEN trim(chunk_text) = '' THEN 0.0 ELSE {_prior_sql('lower(chunk_text)')} END AS sec, {_weights_sql(V.UNWANTED)}::DOUBLE AS pen, len(list_intersect(qt, list_distinct({M.terms(_header_text)}))) / len(qt)::DOUBLE AS hdr, {_digits} AS g, {_letters} AS l FROM f3),
 f5 AS (SELECT *, CASE WHEN g / greatest(1, g + l)::DOUBLE > 0.18 THEN least(0.35, (g / (g + l)::DOUBLE - 0.18) * 1.5) ELSE 0 END AS p0 FROM f4),
 f6 AS (SELECT *, CASE WHEN list_contains(asked, 'financial_metrics') OR g = 0 THEN 0 ELSE least(0.6, CASE WHEN section_group = 'financial_statements' THEN greatest(p0, 0.35) ELSE p0 END) END AS num FROM f5),
 f7 AS (SELECT *, 0.48 * {_norm('score')} + 0.27 * {_norm('bm')} + 0.15 * coverage + 0.20 * sec - 0.15 * pen + 0.08 * know AS hyb FROM f6),
 f8 AS (SELECT *, round(0.30 * hyb + 0.18 * coverage + 0.24 * sec + 0.12 * hdr + 0.10 * {_norm('coverage')} + 0.10 * {_norm('bm')} - 0.10 * num - 0.15 * pen + 0.10 * know, 9) AS final FROM f7)
 SELECT query_id, chunk_id, round(final, 6) AS final_score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS r FROM f8) WHERE r <= 5"""


_hybrid = _hybrid_sql()


@query("top3_hybrid", _hybrid)
def top3(spark, sf):
    out = retrieval.hybrid(_index(spark, sf), _search(spark, sf), 5)
    return out.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


_RELATION_NAMES = ["COMPETES_WITH", "offers ", "REPORTS", "LEADS_BY", "FACES_RISK_FROM", "MENTIONS"]
# Facts of a chunk here: its section's name as text, and one relation.
_known = f"""least(1.0, 0.70 * len(list_intersect(qt, list_distinct({M.terms("replace(section_group, '_', ' ')")}))) / len(qt)::DOUBLE + 0.30 * greatest(
 CASE WHEN rel = 'COMPETES_WITH' AND list_contains(asked, 'competition') THEN 1.0 ELSE 0 END, CASE WHEN rel = 'REPORTS' AND list_contains(asked, 'financial_metrics') THEN 1.0 ELSE 0 END,
 CASE WHEN rel = 'FACES_RISK_FROM' AND list_contains(asked, 'risk_factors') THEN 1.0 ELSE 0 END, CASE WHEN rel = 'offers ' AND regexp_matches(lower(query_text), 'offer|product|platform|service') THEN 0.85 ELSE 0 END,
 CASE WHEN rel = 'LEADS_BY' AND regexp_matches(lower(query_text), 'ceo|chief executive|lead|led by|executive') THEN 0.85 ELSE 0 END, CASE WHEN rel = 'MENTIONS' AND lower(query_text) LIKE '%mention%' THEN 0.5 ELSE 0 END))"""
_rel = f"{_RELATION_NAMES!r}[doc_id % 6 + 1]"


@query("scr10_hybrid_with_facts", _hybrid_sql(known=_known.replace("rel =", f"{_rel} =")))
def scr10(spark, sf):
    """The staged ranking with what is known of each chunk."""
    relation = F.element_at(F.array(*[F.lit(r) for r in _RELATION_NAMES]), (F.col("doc_id") % 6).cast("int") + 1)
    facts = M.chunks(spark, sf).select("chunk_id", F.replace("section_group", F.lit("_"), F.lit(" ")).alias("knowledge_text"), F.array(relation).alias("knowledge_relations"))
    out = retrieval.hybrid(_index(spark, sf), _search(spark, sf), 5, facts)
    return out.select("query_id", "chunk_id", F.round("final_score", 6).alias("final_score"), "rank")


def _mode_sql(name: str, sql: str, score: str) -> str:
    return f"SELECT query_id, chunk_id, '{name}' AS retrieval_mode, round({score}, 6) AS final_score, rank FROM ({sql})"


_naive = f"""WITH {_sql_base()}, near AS (SELECT k.query_id, c.chunk_id, {_cos} AS score FROM kept k JOIN q USING (query_id) JOIN cand c USING (chunk_id))
 SELECT query_id, chunk_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM near) WHERE r <= 5"""


@query("scr14_all_modes", " UNION ALL ".join([_mode_sql("classical_ml", _filtered, "score"), _mode_sql("naive", _naive, "score"), _mode_sql("improved", _hybrid, "final_score")]))
def scr14(spark, sf):
    """The same questions in all three modes, in one schema."""
    vectors = M.read(spark, sf, "embeddings").select(F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("chunk_id"), "embedding")
    out = retrieval.retrieve_all(M.chunks(spark, sf), vectors, _search(spark, sf), 5, list(V.MODES))
    return out.select("query_id", "chunk_id", "retrieval_mode", F.round("final_score", 6).alias("final_score"), "rank")


@query("scr2_bm25", f"WITH {_sql_base()}, near AS (SELECT * FROM (SELECT k.query_id, c.chunk_id, {_cos} AS score FROM kept k JOIN q USING (query_id) JOIN cand c USING (chunk_id)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {_dense_pool}),\n pool AS (SELECT query_id, chunk_id, chunk_text, section_title FROM near JOIN cand USING (chunk_id)), {_bm25} SELECT query_id, chunk_id, round(coalesce(bm25_score, 0), 6) AS bm25_score FROM pool LEFT JOIN bm USING (query_id, chunk_id)")
def scr2(spark, sf):
    indexed, asked = _index(spark, sf), _search(spark, sf)
    ready = retrieval.marks(indexed)
    near = retrieval.dense(ready, retrieval.with_levels(asked, ready), _dense_pool).select("query_id", "chunk_id")
    text = F.concat(F.coalesce("section_title", F.lit("")), F.lit("\n"), "chunk_text")
    pairs = near.join(indexed.select("chunk_id", text.alias("text")), "chunk_id")
    return retrieval.bm25(pairs, asked).select("query_id", "chunk_id", F.round("bm25_score", 6).alias("bm25_score"))


@query(
    "scr15_naive_mode",
    f"""WITH {_sql_base()}, near AS (SELECT k.query_id, c.chunk_id, {_cos} AS score FROM kept k JOIN q USING (query_id) JOIN cand c USING (chunk_id))
 SELECT query_id, chunk_id, score, score AS final_score, 0.0::DOUBLE AS hybrid_score, 'naive' AS retrieval_mode, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM near) WHERE r <= 3""",
)
def scr15(spark, sf):
    indexed = _index(spark, sf)
    out = retrieval.baseline_schema(retrieval.dense(indexed, retrieval.with_levels(_search(spark, sf), indexed), 3), retrieval.mode("baseline"))
    return out.select("query_id", "chunk_id", "score", "final_score", "hybrid_score", "retrieval_mode", "rank")


@query(
    "txt10_context_blocks",
    f"""WITH {M.CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_start) AS rank FROM chunks)
 SELECT doc AS query_id, sha256(string_agg('[SOURCE ' || rank || ']' || chr(10) || 'doc_id: ' || doc || chr(10) || 'company: ' || company || chr(10) || 'fiscal_year: ' || fiscal_year || chr(10) || 'pages: ' || page_start || '-' || page_start || chr(10)
 || 'section_group: ' || section_group || chr(10) || CASE WHEN section_title IS NULL THEN '' ELSE 'section_title: ' || section_title || chr(10) END || 'chunk_id: ' || chunk_id || chr(10) || 'text:' || chr(10) || chunk_text || chr(10), chr(10) || chr(10) ORDER BY rank)) AS sha FROM r GROUP BY doc""",
)
def txt10(spark, sf):
    rows = M.chunks(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("page_start")))
    rows = rows.select(F.col("doc").alias("query_id"), F.col("doc").alias("doc_id"), "company", "fiscal_year", "page_start", F.col("page_start").alias("page_end"), "section_group", "section_title", "chunk_id", "chunk_text", "rank")
    return answering.context_blocks(rows).select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("sha"))


@query(
    "evl9_retrieval_check",
    f"""WITH {_sql_base()}, near AS (SELECT k.query_id, c.chunk_id, c.company, {_cos} AS score FROM kept k JOIN q USING (query_id) JOIN cand c USING (chunk_id)), t AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1)
 SELECT query_id, chunk_id, CASE WHEN company_filter IS NOT NULL THEN company = company_filter END AS company_match, NULL::BOOLEAN AS year_match FROM q JOIN t USING (query_id)""",
)
def evl9(spark, sf):
    indexed, asked = _index(spark, sf), _search(spark, sf)
    found = retrieval.dense(indexed, retrieval.with_levels(asked, indexed), 3).join(indexed.select("chunk_id", "company", "fiscal_year"), "chunk_id")
    wanted = asked.select("query_id", F.col("company_filter").alias("expected_company"), F.lit(None).cast("int").alias("expected_year"))
    return evaluation.retrieval_check(found, wanted)


@query("udf1_embed_missing")
def udf1(spark, sf):
    """Vectors of all chunks by an injected encoder, here one that hashes words."""
    return answering.embed(M.chunks(spark, sf), "chunk_id", "chunk_text", answering.hash_encoder())


@query(
    "udf2_cached_answers",
    f"WITH {M.CHUNKS}, w AS (SELECT doc_id, {M.word_list('chunk_text')} AS w FROM chunks) SELECT doc_id, CASE WHEN len(w) > 0 THEN w[1] ELSE '' END AS answer, len(w)::INT AS n, 'success' AS status FROM w",
)
def udf2(spark, sf):
    """Answers of an injected model to all chunks through the cache, asked twice: the second time none is called."""
    from ..operators.answer_cache import AnswerCache

    def call(prompt: str, tokens: int) -> str:
        words = prompt.split()
        return json.dumps({"answer": words[0] if words else "", "n": len(words)})

    cache = AnswerCache(Versions(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"))
    rows = M.chunks(spark, sf).select("doc_id", "chunk_text")
    cache.ask(rows, "doc_id", "chunk_text", call)
    said = F.from_json("response", "answer string, n int")
    return cache.ask(rows, "doc_id", "chunk_text", call).where("from_cache").select("doc_id", said["answer"].alias("answer"), said["n"].alias("n"), "status")


@query(
    "udf5_extract",
    f"""WITH {M.CHUNKS}, w AS (SELECT *, {M.word_list('chunk_text')} AS w FROM chunks)
 SELECT chunk_id, w[1] AS entity_text, 'company' AS entity_type, 0.5::DOUBLE AS confidence, doc AS source_doc_id, fiscal_year AS year, company, page_start, page_start AS page_end FROM w WHERE len(w) > 0 AND length(w[1]) > 1""",
)
def udf5(spark, sf):
    """Entities by an injected model over all chunks, here one that names the first word of each."""

    def call(prompt: str, tokens: int) -> str:
        import json

        words = prompt.split("\n", 1)[1].split()
        return json.dumps({"entities": [{"entity_text": w, "entity_type": "company", "confidence": 0.5} for w in words[:1]]})

    rows = M.chunks(spark, sf).select("chunk_id", F.col("doc").alias("doc_id"), "company", "fiscal_year", "page_start", F.col("page_start").alias("page_end"), "chunk_text")
    return answering.extract(rows, call)[0].drop("ordinal")
