"""Queries over tables: keyed state, knowledge, evaluation, windows of events; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import checks, evaluation, incremental, knowledge
from ..sources import records, scratch, tables
from ..streaming import events as S
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


# Sources, checks ------------------------------------------------------------------------------------------------


@query("src1_scan", "SELECT source, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars > 100 GROUP BY source, lang")
def src1(spark, sf):
    docs = tables.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "source", "lang", "n_chars"])
    return docs.where("n_chars > 100").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("src4_optional_columns", "SELECT item_id, text, NULL::VARCHAR AS section_code, NULL::INT AS fiscal_year FROM benchmark")
def src4(spark, sf):
    return tables.read_optional(spark, f"{sf}/benchmark.parquet", {"item_id": "long", "text": "string", "section_code": "string", "fiscal_year": "int"})


@query("src4_optional_table", "SELECT NULL::VARCHAR AS chunk_id, NULL::INT AS record_count WHERE false")
def src4_missing(spark, sf):
    return tables.read_optional(spark, f"{sf}/no_such_table.parquet", {"chunk_id": "string", "record_count": "int"})


@query(
    "src6_report_names",
    """SELECT s_suppkey, 'acme' || s_suppkey AS company, (2000 + s_suppkey % 25)::INT AS fiscal_year, 'acme' || s_suppkey || '_' || (2000 + s_suppkey % 25) || '_10k' AS doc_id FROM supplier WHERE s_suppkey % 3 > 0""",
)
def src6(spark, sf):
    k = F.col("s_suppkey")
    name = F.when(k % 3 > 0, F.concat(F.lit("acme"), k, F.lit("_"), k % 25 + 2000, F.lit("_10k.pdf"))).otherwise("Notes.pdf")
    files = M.read(spark, sf, "supplier").select("s_suppkey", name.alias("file_name"))
    return tables.reports(files, strict=False).select("s_suppkey", "company", "fiscal_year", "doc_id")


@query(
    "src11_latest_success",
    """SELECT user_id, event_id AS line, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'error' AND event_id % 5 > 0) WHERE r = 1""",
)
def src11(spark, sf):
    status = F.when((F.col("event_id") % 5 > 0) & (F.col("event_type") != "error"), "success").otherwise("error")
    log = M.read(spark, sf, "events").select("user_id", F.col("event_id").alias("line"), "value", status.alias("status"))
    return tables.latest_success(log, "user_id").select("user_id", "line", "value")


@query("flt11_duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*)::BIGINT AS count FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def flt11(spark, sf):
    return checks.duplicates(M.read(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


# Keyed state ---------------------------------------------------------------------------------------------------


@query("join6_missing_rows", f"SELECT d.doc_id, sha256({M.strip('text')}) AS text_hash FROM documents d ANTI JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def join6(spark, sf):
    docs = incremental.with_hash(M.read(spark, sf, "documents").select("doc_id", "text"), "text").withColumn("embedding_model", F.lit("m"))
    cached = docs.join(M.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "embedding_model", "text_hash")
    return incremental.missing_rows(docs, cached, ["doc_id", "embedding_model", "text_hash"]).select("doc_id", "text_hash")


@query(
    "join7_pending",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""",
)
def join7(spark, sf):
    labels = M.read(spark, sf, "labels")
    chunks = M.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    output = labels.where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    point = labels.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("toxic") == 0, "success").otherwise("error").alias("status"))
    return incremental.pending(chunks, output, point).select(F.col("chunk_id").alias("doc_id"))


@query(
    "set4_upsert",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def set4(spark, sf):
    rows = M.read(spark, sf, "events").select("user_id", "event_id", "value", F.col("event_id").alias("ordinal"), "event_type")
    old, new = rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'")
    return incremental.upsert(old, new, ["user_id"]).select("user_id", "event_id", "value")


@query(
    "set2_union_keep_last",
    """SELECT doc_id, quality, txt FROM (SELECT doc_id, NULL::INT AS quality, upper(lang) AS txt, 0 AS s FROM documents UNION ALL SELECT doc_id, quality, NULL, 1 FROM labels) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) = 1""",
)
def set2(spark, sf):
    docs = M.read(spark, sf, "documents").select("doc_id", F.upper("lang").alias("txt"))
    return incremental.union_keep_last(docs, M.read(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"]).select("doc_id", "quality", "txt")


@query("agg12_bootstrap", "SELECT l_orderkey AS chunk_id, 'success' AS status, count(*)::INT AS record_count, '' AS error_message FROM lineitem GROUP BY l_orderkey")
def agg12(spark, sf):
    return incremental.checkpoint_from_output(M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id")))


@query("win2_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def win2(spark, sf):
    rows = M.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return incremental.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("win6_numbering", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS place FROM orders")
def win6(spark, sf):
    rows = M.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return incremental.numbered(rows, ["o_orderdate", "o_orderkey"], "place", 0, ["o_custkey"]).drop("o_orderdate")


@query("top9_numbered_in_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def top9(spark, sf):
    from ..sources.tables import numbered_in_order

    rows = M.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return numbered_in_order(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], "place").drop("o_totalprice")


@query("src9_bad_lines", "SELECT place, o_orderkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey, o_custkey FROM orders) WHERE o_custkey % 50 = 7")
def src9(spark, sf):
    """Orders written in order as JSON lines, those of some customers cut short; their places by file and line, and the key that was left."""
    rows = M.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    whole = tables.json_record(["o_orderkey", "o_custkey", "o_orderpriority"], rows)
    cut = F.when(F.col("o_custkey") % 50 == 7, F.regexp_replace(whole, r"[}]$", "")).otherwise(whole)
    path = f"{scratch.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.orderBy("o_orderkey").select(cut.alias("value")).write.text(path)
    scratch.remove_at_end(spark, path)
    lines = records.numbered_lines(spark, path).groupBy("file").agg(F.max("line").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    bad = records.bad_lines(spark, path, "o_orderkey long, o_custkey long, o_orderpriority string")
    joined = bad.join(lines.select("file", F.coalesce(before, F.lit(0)).alias("before")), "file")
    return joined.select((F.col("before") + F.col("line")).alias("place"), F.regexp_extract("text", '"o_orderkey":([0-9]+)', 1).cast("long").alias("o_orderkey"))


@query(
    "sup8_json_records",
    """SELECT l_orderkey, l_linenumber, '{"part":' || l_partkey || ',"price":' || CASE WHEN l_linenumber = 3 THEN 'null' ELSE l_quantity::INT::VARCHAR || '.0' END || ',"flag":' || CASE WHEN l_linenumber = 2 THEN 'null' ELSE '"' || l_returnflag || '"' END || '}' AS record FROM lineitem""",
)
def sup8(spark, sf):
    from ..sources.tables import json_record

    n = F.col("l_linenumber")
    price = F.when(n == 3, float("nan")).otherwise(F.col("l_quantity").cast("int").cast("double"))
    rows = M.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), price.alias("price"), F.when(n != 2, F.col("l_returnflag")).alias("flag"))
    return rows.select("l_orderkey", "l_linenumber", json_record(["part", "price", "flag"], rows).alias("record"))


# Knowledge -----------------------------------------------------------------------------------------------------

_TYPES = ["company", "Person", "products", "metric", "bogus", " Financial Metrics ", "executive"]
_words = M.word_list("text")


def _responses(spark, sf):
    """Model answers as JSON, one for each row: every word an entity, every pair of neighbours a relation."""
    from ..functions.text import words

    docs = M.chunks(spark, sf).withColumn("w", words(F.col("chunk_text")))
    kind = lambda i: F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (i % len(_TYPES)).cast("int") + 1)
    found = F.transform("w", lambda x, i: F.struct(x.alias("entity_text"), kind(i).alias("entity_type"), ((i % 13) / 10.0).alias("confidence")))
    names = ["offers", "COMPETITOR_OF", "LED_BY", "REPORTS", "likes", "MENTIONS"]
    name = lambda i: F.element_at(F.array(*[F.lit(t) for t in names]), (i % len(names)).cast("int") + 1)
    after = lambda x, i: F.concat(x, F.lit(" "), F.when(i % 4 == 0, "$5 revenue").when(i % 4 == 1, "Smith").otherwise("products"))
    related = F.transform("w", lambda x, i: F.struct(x.alias("entity_a"), name(i).alias("relation"), after(x, i).alias("entity_b")))
    return docs.select(
        "chunk_id",
        F.col("doc").alias("doc_id"),
        "company",
        "fiscal_year",
        "page_start",
        (F.col("page_start") + 1).alias("page_end"),
        F.to_json(F.struct(found.alias("entities"), related.alias("triplets"))).alias("response"),
    )


_entity_sql = f"""WITH {M.CHUNKS}, w AS (SELECT chunk_id, company, fiscal_year, {M.word_list('chunk_text')} AS w FROM chunks),
 e AS (SELECT chunk_id, company, fiscal_year, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
 t AS (SELECT *, ['company', 'executive', 'product', 'financial_metric', NULL, 'financial_metric', 'executive'][i % 7 + 1] AS kind FROM e),
 ok AS (SELECT * FROM t WHERE kind IS NOT NULL AND length(x) > 1 AND NOT (kind = 'product' AND lower(x) IN ({M.quoted(V.NOT_PRODUCTS)}))
 AND NOT (kind = 'financial_metric' AND lower(x) IN ({M.quoted(V.NOT_METRICS)})) AND NOT (kind = 'executive' AND lower(x) IN ({M.quoted(V.NOT_EXECUTIVES)}))),
 entities AS (SELECT *, least(1.0, (i % 13) / 10.0) AS confidence FROM ok QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(x), kind ORDER BY i) = 1)"""


@query("ent1_entities", f"{_entity_sql} SELECT chunk_id, x AS entity_text, kind AS entity_type, confidence::DOUBLE AS confidence, fiscal_year AS year FROM entities")
def ent1(spark, sf):
    return knowledge.entities(_responses(spark, sf)).select("chunk_id", "entity_text", "entity_type", "confidence", "year")


_triplet_sql = f"""WITH {M.CHUNKS}, w AS (SELECT chunk_id, company, fiscal_year, {M.word_list('chunk_text')} AS w FROM chunks),
 e AS (SELECT chunk_id, company, fiscal_year, unnest(w) AS a, unnest(range(len(w))) AS i FROM w),
 t AS (SELECT *, a || ' ' || ['$5 revenue', 'Smith', 'products', 'products'][i % 4 + 1] AS b, ['OFFERS', 'COMPETES_WITH', 'LEADS_BY', 'REPORTS', NULL, 'MENTIONS'][i % 6 + 1] AS rel FROM e),
 ok AS (SELECT * FROM t WHERE rel IS NOT NULL AND length(a) >= 2 AND lower(a) NOT IN ({M.quoted(V.GENERIC_ENDS)}) AND lower(b) NOT IN ({M.quoted(V.GENERIC_ENDS)}) AND lower(a) <> lower(b)
 AND (rel <> 'OFFERS' OR lower(b) NOT IN ({M.quoted(V.NOT_OFFERS)})) AND (rel <> 'REPORTS' OR {M.found('lower(b)', V.METRIC_SIGNALS)})
 AND (rel <> 'LEADS_BY' OR (lower(b) NOT IN ({M.quoted(V.NOT_LEADERS)}) AND NOT {M.found('lower(b)', V.NOT_LEADER_PATTERNS)} AND i % 4 = 1 AND regexp_matches(a, '^\\p{{Lu}}')))),
 triplets AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY chunk_id, lower(a), rel, lower(b) ORDER BY i) = 1)"""


@query("ent2_triplets", f"{_triplet_sql} SELECT chunk_id, a AS entity_a, rel AS relation, b AS entity_b, fiscal_year AS year, company FROM triplets")
def ent2(spark, sf):
    """Relations from model answers, after all rules."""
    return knowledge.triplets(_responses(spark, sf)).select("chunk_id", "entity_a", "relation", "entity_b", "year", "company")


_both_sql = _triplet_sql.removeprefix(f"WITH {M.CHUNKS}, ").replace(" w AS ", " w2 AS ").replace("w AS (", "w2 AS (", 1).replace("FROM w)", "FROM w2)").replace(" e AS (", " e2 AS (").replace("FROM e)", "FROM e2)")
_both_sql = _both_sql.replace(" t AS (", " t2 AS (").replace("FROM t WHERE", "FROM t2 WHERE").replace(" ok AS (", " ok2 AS (").replace("FROM ok QUALIFY", "FROM ok2 QUALIFY")


def _distinct_sql(name: str, table: str, text: str, where: str = "true") -> str:
    """CTE: a chunk's texts in order, the first spelling of each."""
    first = f"SELECT chunk_id, min(i) AS i, arg_min({text}, i) AS x FROM {table} WHERE {where} GROUP BY chunk_id, lower({text})"
    return f"{name} AS (SELECT chunk_id, list(x ORDER BY i, x) AS {name} FROM ({first}) GROUP BY chunk_id)"


_sides = [
    _distinct_sql("names", "entities", "x"),
    _distinct_sql("kinds", "entities", "kind"),
    _distinct_sql("labels", "triplets", "a || ' [' || rel || '] ' || b"),
    _distinct_sql("relations", "triplets", "rel"),
    _distinct_sql("rivals", "triplets", "b", "rel = 'COMPETES_WITH'"),
]
_sha = lambda x: f"sha256(array_to_string({x}, ' '))"


@query(
    "agg2_chunk_facts",
    f"""{_entity_sql}, {_both_sql}, {', '.join(_sides)},
 every AS (SELECT chunk_id, coalesce(names, []) AS names, kinds, coalesce(labels, []) AS labels, coalesce(relations, []) AS relations, coalesce(rivals, []) AS rivals
 FROM names FULL JOIN kinds USING (chunk_id) FULL JOIN labels USING (chunk_id) FULL JOIN relations USING (chunk_id) FULL JOIN rivals USING (chunk_id))
 SELECT chunk_id, len(names)::INT AS entity_count, {_sha('names')} AS names_sha, array_to_string(names[:5], ' | ') AS preview, len(labels)::INT AS triplet_count, {_sha('labels')} AS triplets_sha,
 array_to_string(coalesce(kinds, []), ',') AS kinds, array_to_string(relations, ',') AS relations, {_sha('rivals')} AS rivals_sha, {_sha('names || labels || rivals')} AS text_sha FROM every""",
)
def agg2(spark, sf):
    facts = knowledge.response_facts(_responses(spark, sf))
    sha = lambda c: F.sha2(F.array_join(c, " ").cast("binary"), 256)
    return facts.select(
        "chunk_id",
        "entity_count",
        sha("knowledge_entities").alias("names_sha"),
        F.col("knowledge_entities_preview").alias("preview"),
        "triplet_count",
        sha("knowledge_triplets").alias("triplets_sha"),
        F.array_join("knowledge_entity_types", ",").alias("kinds"),
        F.array_join("knowledge_relations", ",").alias("relations"),
        sha("knowledge_competitors").alias("rivals_sha"),
        F.sha2(F.col("knowledge_text").cast("binary"), 256).alias("text_sha"),
    )


@query(
    "agg3_top_entities",
    f"{_entity_sql} SELECT x AS entity_text, kind AS entity_type, count(*)::BIGINT AS mentions, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM entities GROUP BY x, kind ORDER BY mentions DESC, x, kind LIMIT 25",
)
def agg3(spark, sf):
    return knowledge.top_counts(knowledge.entities(_responses(spark, sf)), ["entity_text", "entity_type"], "year", 25)


@query(
    "agg4_top_triplets",
    f"{_triplet_sql} SELECT rel AS relation, a AS entity_a, b AS entity_b, count(*)::BIGINT AS mentions, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year FROM triplets GROUP BY 1, 2, 3 ORDER BY mentions DESC, relation, entity_a, entity_b LIMIT 25",
)
def agg4(spark, sf):
    return knowledge.top_counts(knowledge.triplets(_responses(spark, sf)), ["relation", "entity_a", "entity_b"], "year", 25)


_SUFFIX = [" Inc.", ", Corp", " Group", " LLC", "", " Incorporated, Ltd.", " & Co-op's plc"]
_name = f"p_name || {_SUFFIX!r}[p_partkey % {len(_SUFFIX)} + 1]".replace('"', "'").replace(" & Co-op's plc", " & Co-op''s plc")


def _names(spark, sf):
    tail = F.element_at(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("p_partkey") % len(_SUFFIX)).cast("int") + 1)
    return M.read(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("raw"))


def _strip_suffixes(x: str) -> str:
    for p in V.LEGAL_SUFFIXES:
        x = M.strip(f"regexp_replace({x}, '(?i){p}', '')")
    return x


_title = r"""array_to_string(list_transform(range(length(x)), i -> CASE WHEN i = 0 OR NOT regexp_matches(substr(x, i::INT, 1), '\p{L}') THEN upper(substr(x, i::INT + 1, 1)) ELSE substr(x, i::INT + 1, 1) END), '')"""


@query("cmp2_competitor_names", f"SELECT p_partkey, {_title} AS name FROM (SELECT p_partkey, {_strip_suffixes('lower(raw)')} AS x FROM (SELECT p_partkey, {_name} AS raw FROM part))")
def cmp2(spark, sf):
    return _names(spark, sf).select("p_partkey", knowledge.competitor_name(F.col("raw")).alias("name"))


@query(
    "cmp3_name_rules",
    f"""SELECT p_partkey, lower(x) IN ({M.quoted(V.NOT_COMPETITORS)}) OR {M.found('lower(x)', V.NOT_COMPETITOR_PATTERNS)} AS blacklisted,
 {M.word_count('x')} > 8 OR {M.hits('lower(x)', V.GENERIC_NAME_PATTERNS)} >= 2 AS generic, {M.found('lower(x)', V.COMPETITION_SIGNALS)} AS signal
 FROM (SELECT p_partkey, p_name || ['', ' Foundation', ' software products', ' risk', ' University market'][p_partkey % 5 + 1] AS x FROM part)""",
)
def cmp3(spark, sf):
    tail = F.element_at(F.array(*[F.lit(s) for s in ("", " Foundation", " software products", " risk", " University market")]), (F.col("p_partkey") % 5).cast("int") + 1)
    rows = M.read(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("x"))
    x = F.col("x")
    return rows.select("p_partkey", knowledge.is_blacklisted(x).alias("blacklisted"), knowledge.is_generic(x).alias("generic"), knowledge.has_signal(x).alias("signal"))


@query(
    "cmp1_source_company",
    """SELECT n_nationkey, CASE WHEN lower(x) IN ('adobe', 'adobe inc.', 'adobe inc') THEN 'adobe' WHEN lower(x) IN ('lockheed martin', 'lockheed martin corporation', 'lockheedmartin') THEN 'lockheedmartin' ELSE lower(x) END AS company,
 n_nationkey % 4 < 2 AS self FROM (SELECT n_nationkey, ['Adobe Inc.', 'LOCKHEED Martin', n_name, 'pfizer'][n_nationkey % 4 + 1] AS x FROM nation)""",
)
def cmp1(spark, sf):
    k = F.col("n_nationkey")
    x = F.element_at(F.array(F.lit(" Adobe  Inc."), F.lit("LOCKHEED Martin"), F.col("n_name"), F.lit("pfizer")), (k % 4).cast("int") + 1)
    rows = M.read(spark, sf, "nation").select("n_nationkey", x.alias("x"), F.when(k % 2 == 0, "adobe inc").otherwise("lockheedmartin").alias("own"))
    return rows.select("n_nationkey", knowledge.source_company(F.col("x")).alias("company"), knowledge.is_self(F.col("x"), F.col("own")).alias("self"))


@query(
    "join5_evidence",
    f"WITH {M.CHUNKS} SELECT o.o_orderkey, coalesce(CASE WHEN length(chunk_text) > 280 THEN replace(chunk_text[:280], chr(10), ' ') || '...' ELSE replace(chunk_text, chr(10), ' ') END, '') AS chunk_text_preview FROM orders o LEFT JOIN chunks c ON c.doc_id = o.o_orderkey",
)
def join5_evidence(spark, sf):
    found = M.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("chunk_id"))
    texts = M.chunks(spark, sf).select(F.col("doc_id").alias("chunk_id"), "chunk_text")
    return knowledge.with_evidence(found, texts).select("o_orderkey", "chunk_text_preview")


def _mentions(spark, sf):
    """Mentions in the shape of the model: parts named by suppliers."""
    lines, parts = M.read(spark, sf, "lineitem"), M.read(spark, sf, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("chunk_id"),
        (F.col("l_suppkey") % 50).alias("source_company"),
        F.year("l_shipdate").alias("year"),
        F.col("p_brand").alias("competitor_name"),
        F.col("l_linenumber").alias("page_start"),
        (F.col("l_linenumber") + 1).alias("page_end"),
        (F.col("l_discount") > 0.05).alias("has_competition_risk_signal"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("explicit_competes_with"),
    )


_summary = """summary AS (SELECT l_suppkey % 50 AS source_company, year(l_shipdate)::INT AS year, p_brand AS competitor_name, count(*)::BIGINT AS mention_count, sum((l_discount > 0.05)::INT)::BIGINT AS competition_risk_mentions,
 sum((l_returnflag = 'R' AND l_quantity > 45)::INT)::BIGINT AS explicit_competes_with_count, min(l_linenumber)::INT AS first_page_seen, max(l_linenumber + 1)::INT AS last_page_seen
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
_strong = "strong AS (SELECT * FROM summary WHERE explicit_competes_with_count > 0 OR (competition_risk_mentions >= 1 AND mention_count >= 2))"


@query("agg1_competitor_summary", f"WITH {_summary} SELECT * FROM summary")
def agg1(spark, sf):
    return knowledge.competitor_summary(_mentions(spark, sf))


@query("cmp4_clean_summary", f"WITH {_summary}, {_strong} SELECT * FROM strong")
def cmp4(spark, sf):
    return knowledge.clean_summary(knowledge.competitor_summary(_mentions(spark, sf)))


@query("win3_new_by_year", f"WITH {_summary} SELECT source_company, min(year)::INT AS year, competitor_name AS new_competitor_name FROM summary GROUP BY source_company, competitor_name")
def win3(spark, sf):
    return knowledge.new_by_year(knowledge.competitor_summary(_mentions(spark, sf)))


@query(
    "agg10_yearly_pivot",
    """SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1""",
)
def agg10(spark, sf):
    rows = M.read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return knowledge.yearly_pivot(rows, "year", "o_orderstatus", "o_custkey", ["F", "O", "P"])


@query("agg11_leaders", f"WITH {_summary} SELECT source_company, year, competitor_name, mention_count FROM summary QUALIFY row_number() OVER (PARTITION BY source_company, year ORDER BY mention_count DESC, competitor_name) = 1")
def agg11(spark, sf):
    out = knowledge.competitor_summary(_mentions(spark, sf)).select("source_company", "year", "competitor_name", "mention_count")
    return knowledge.leaders(out, ["source_company", "year"], [-F.col("mention_count"), F.col("competitor_name")])


@query(
    "top8_competitor_evidence",
    f"WITH {_summary}, {_strong} SELECT source_company, year, competitor_name, mention_count FROM strong ORDER BY mention_count DESC, competitor_name, source_company, year LIMIT 8",
)
def top8(spark, sf):
    out = knowledge.clean_summary(knowledge.competitor_summary(_mentions(spark, sf)))
    return out.orderBy(F.desc("mention_count"), "competitor_name", "source_company", "year").limit(8).select("source_company", "year", "competitor_name", "mention_count")


@query(
    "set1_mentions_once",
    """SELECT l_orderkey, l_suppkey, src FROM (SELECT l_orderkey, l_suppkey, 'entity' AS src FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, l_suppkey, 'triplet' FROM lineitem WHERE l_linestatus = 'F')""",
)
def set1(spark, sf):
    rows = M.read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    one = rows.where("l_returnflag = 'R'").withColumn("src", F.lit("entity"))
    two = rows.where("l_linestatus = 'F'").withColumn("src", F.lit("triplet"))
    both = one.unionByName(two).select("l_orderkey", "l_suppkey", "src", "l_linenumber")
    return incremental.keep_first(both, ["l_orderkey", "l_suppkey", "src"], ["l_linenumber"]).drop("l_linenumber")


@query(
    "join3_optional_facts",
    """SELECT d.doc_id, coalesce(l.n, 0)::INT AS entity_count, coalesce(l.t, '') AS knowledge_text FROM documents d LEFT JOIN (SELECT doc_id, count(*)::INT AS n, string_agg('q' || quality, ' ') AS t FROM labels GROUP BY doc_id) l USING (doc_id)""",
)
def join3(spark, sf):
    none = F.array().cast("array<string>")
    facts = M.read(spark, sf, "labels").select(
        F.col("doc_id").alias("chunk_id"), F.lit(1).alias("entity_count"), F.lit(0).alias("triplet_count"), F.concat(F.lit("q"), "quality").alias("knowledge_text"),
        *[F.lit("").alias(c) for c in ("knowledge_entities_preview", "knowledge_triplets_preview")],
        *[none.alias(c) for c in ("knowledge_entities", "knowledge_triplets", "knowledge_relations", "knowledge_competitors")],
    )
    out = knowledge.with_facts(M.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")), facts)
    return out.select(F.col("chunk_id").alias("doc_id"), "entity_count", "knowledge_text")


@query(
    "join4_all_entity_context",
    f"{_entity_sql} SELECT e.chunk_id, e.x AS entity_text, c.page_start, length(c.chunk_text)::INT AS chars FROM entities e LEFT JOIN chunks c ON c.chunk_id = e.chunk_id WHERE e.kind = 'company'",
)
def join4_all(spark, sf):
    found = knowledge.entities(_responses(spark, sf)).where("entity_type = 'company'")
    chunks = M.chunks(spark, sf).withColumn("chars", F.length("chunk_text"))
    return knowledge.with_context(found, chunks, ("page_start", "chars")).select("chunk_id", "entity_text", "page_start", "chars")


@query("join5_mentions")
def join5(spark, sf):
    """Competitor mentions of both kinds with their evidence, end to end."""
    answers = _responses(spark, sf)
    rows = M.chunks(spark, sf).withColumn("page_end", F.col("page_start"))
    return knowledge.with_evidence(knowledge.response_mentions(answers, rows), rows).drop("chunk_text")


@query("flt7_loose_filter", "SELECT doc_id FROM documents WHERE lower(regexp_replace('Co-' || source, '[^\\p{L}\\p{N}]+', '', 'g')) = 'cosrc3' AND 2022 + doc_id % 3 = 2023")
def flt7(spark, sf):
    from ..operators.answering import loose

    rows = M.read(spark, sf, "documents").select("doc_id", F.concat(F.lit("Co-"), "source").alias("company"), (F.col("doc_id") % 3 + 2022).cast("string").alias("year"))
    return loose(rows, "CO src3", 2023).select("doc_id")


@query("flt8_exact_filter", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'")
def flt8(spark, sf):
    docs = M.read(spark, sf, "documents")
    return docs.where(F.col("source").isin("src1", "src2") & (F.col("lang") == "en")).select("doc_id")


@query("join12_mode_grid", "SELECT item_id, mode, k::INT AS k FROM benchmark, (SELECT unnest(['classical_ml', 'naive', 'improved']) AS mode), (SELECT unnest([3, 5]) AS k)")
def join12(spark, sf):
    modes = F.explode(F.array(*[F.lit(m) for m in V.MODES]))
    grid = M.read(spark, sf, "benchmark").select("item_id", modes.alias("mode"))
    return grid.withColumn("k", F.explode(F.array(F.lit(3), F.lit(5))))


@query("join13_cached_vector", f"SELECT d.doc_id, e.embedding[1]::DOUBLE AS first FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id")
def join13(spark, sf):
    docs = incremental.with_hash(M.read(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "text_hash")
    cache = docs.join(M.read(spark, sf, "embeddings"), docs.doc_id == F.col("vec_id")).select("doc_id", "text_hash", "embedding")
    wanted = docs.join(M.read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return wanted.join(cache, ["doc_id", "text_hash"]).select("doc_id", F.col("embedding")[0].cast("double").alias("first"))


# Evaluation ----------------------------------------------------------------------------------------------------


def _runs(spark, sf):
    """Judged runs in the shape of the model, from documents and their labels."""
    docs, labels = M.read(spark, sf, "documents"), M.read(spark, sf, "labels")
    i = F.col("doc_id")
    cited = F.when(i % 4 == 0, "not json").when(i % 4 == 1, "[]").otherwise('[{"doc_id": "a", "page": "11"}, {"doc_id": "b", "page": 2}]')
    return docs.join(labels, "doc_id").select(
        i.alias("question_id"),
        F.when(F.col("quality") == 1, " Yes").when(i % 10 == 0, "").otherwise("no ").alias("judge_verdict"),
        F.when(i % 9 == 0, "  ").otherwise(F.col("lang")).alias("generated_answer"),
        F.when(i % 8 == 0, "").otherwise(F.col("text")).alias("retrieved_context"),
        (i % 7).cast("int").alias("n_retrieved_chunks"),
        cited.alias("citations"),
        F.when(i % 11 == 0, "lexical_fallback").otherwise("improved").alias("retrieval_mode"),
        F.when(i % 13 == 0, "error").otherwise("success").alias("status"),
        F.when(F.col("toxic") == 1, "bias").when(i % 2 == 0, "prompt_injection").otherwise("hallucination").alias("category"),
    )


_runs_sql = f"""runs AS (SELECT doc_id AS question_id, CASE WHEN quality = 1 THEN 'Yes' WHEN doc_id % 10 = 0 THEN '' ELSE 'no' END AS judge_verdict,
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END AS generated_answer, CASE WHEN doc_id % 8 = 0 THEN '' ELSE {M.strip('text')} END AS retrieved_context, (doc_id % 7)::INT AS n_retrieved_chunks,
 CASE WHEN doc_id % 4 < 2 THEN 0 ELSE 2 END AS n_citations, CASE WHEN doc_id % 11 = 0 THEN 'lexical_fallback' ELSE 'improved' END AS retrieval_mode, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'success' END AS status,
 CASE WHEN toxic = 1 THEN 'bias' WHEN doc_id % 2 = 0 THEN 'prompt_injection' ELSE 'hallucination' END AS category FROM documents JOIN labels USING (doc_id)),
 full_runs AS (SELECT *, judge_verdict = 'Yes' AS is_yes, judge_verdict = 'no' AS is_no, n_citations = 0 AS no_citation, length(retrieved_context)::INT AS context_length_chars, length(generated_answer)::INT AS answer_length_chars FROM runs),
 causes AS (SELECT *, CASE WHEN NOT is_no THEN '' WHEN generated_answer = '' OR status = 'error' THEN 'generation imprecise' WHEN retrieved_context = '' OR n_retrieved_chunks = 0 OR retrieval_mode = 'lexical_fallback' THEN 'mauvais retrieval'
 WHEN n_retrieved_chunks <= 2 OR context_length_chars < 1200 THEN 'contexte incomplet' WHEN n_retrieved_chunks >= 5 AND context_length_chars >= 6000 AND no_citation THEN 'chunking inadequat' ELSE 'generation imprecise' END AS probable_error_cause FROM full_runs)"""


@query("evl3_enriched_runs", f"WITH {_runs_sql} SELECT question_id, judge_verdict, n_citations::INT AS n_citations, no_citation, is_yes, is_no, answer_length_chars, context_length_chars FROM full_runs")
def evl3(spark, sf):
    return evaluation.enrich(_runs(spark, sf)).select("question_id", "judge_verdict", "n_citations", "no_citation", "is_yes", "is_no", "answer_length_chars", "context_length_chars")


@query("evl4_error_causes", f"WITH {_runs_sql} SELECT question_id, probable_error_cause FROM causes")
def evl4(spark, sf):
    return evaluation.enrich(_runs(spark, sf)).select("question_id", evaluation.error_cause().alias("probable_error_cause"))


@query(
    "evl5_judge",
    f"WITH {_runs_sql} SELECT question_id, CASE WHEN generated_answer = '' OR retrieved_context = '' THEN 'No' WHEN judge_verdict = 'Yes' THEN 'Yes' WHEN judge_verdict = 'no' THEN 'No' END AS judge_verdict, CASE WHEN generated_answer = '' THEN 'shortcut_empty_answer' WHEN retrieved_context = '' THEN 'shortcut_empty_context' ELSE 'success' END AS judge_status FROM runs",
)
def evl5(spark, sf):
    runs = _runs(spark, sf).withColumnRenamed("judge_verdict", "said")
    return evaluation.judge(runs, F.col("said")).select("question_id", "judge_verdict", "judge_status")


@query(
    "agg5_summary_metrics",
    f"WITH {_runs_sql} SELECT count(*)::BIGINT AS total_questions, count_if(is_yes)::BIGINT AS number_of_yes, count_if(is_no)::BIGINT AS number_of_no, avg(is_yes::INT)::DOUBLE AS accuracy, count_if(no_citation)::BIGINT AS number_without_citation, avg(no_citation::INT)::DOUBLE AS no_citation_rate FROM full_runs",
)
def agg5(spark, sf):
    return evaluation.summary_metrics(evaluation.enrich(_runs(spark, sf)))


@query("agg6_distribution", f"WITH {_runs_sql} SELECT coalesce(nullif(judge_verdict, ''), '<missing>') AS value, count(*)::BIGINT AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM runs GROUP BY 1")
def agg6(spark, sf):
    return evaluation.distribution(_runs(spark, sf), "judge_verdict", "<missing>")


@query(
    "top7_examples",
    f"WITH {_runs_sql} SELECT question_id, probable_error_cause, answer_length_chars, n_retrieved_chunks FROM causes WHERE is_no ORDER BY probable_error_cause, answer_length_chars DESC, n_retrieved_chunks DESC, question_id LIMIT 3",
)
def top7(spark, sf):
    runs = evaluation.enrich(_runs(spark, sf)).withColumn("probable_error_cause", evaluation.error_cause())
    return evaluation.examples(runs, "No").select("question_id", "probable_error_cause", "answer_length_chars", "n_retrieved_chunks")


@query(
    "agg7_security_rates",
    f"""WITH {_runs_sql}, r AS (SELECT category, is_yes AS s, generated_answer = 'en' AS f, no_citation AS c, CASE WHEN category = 'prompt_injection' THEN is_yes AND NOT no_citation END AS i, CASE WHEN category = 'bias' THEN NOT no_citation END AS b FROM full_runs)
 SELECT count(*)::BIGINT AS total_cases, avg(s::INT)::DOUBLE AS support_rate, avg(f::INT)::DOUBLE AS refusal_rate, avg(c::INT)::DOUBLE AS fabricated_citation_rate, coalesce(avg(CASE WHEN category = 'prompt_injection' THEN coalesce(i, false)::INT END), 0)::DOUBLE AS injection_resistance_rate,
 coalesce(avg(CASE WHEN category = 'bias' THEN coalesce(b, false)::INT END), 0)::DOUBLE AS bias_safe_response_rate FROM r""",
)
def agg7(spark, sf):
    runs = evaluation.enrich(_runs(spark, sf))
    made_up, answer = F.col("no_citation"), F.col("generated_answer")
    records = runs.select(
        "category",
        F.col("is_yes").alias("support_hit"),
        (answer == "en").alias("refusal_detected"),
        made_up.alias("fabricated_citation"),
        evaluation.injection_resisted(F.col("category"), answer, F.col("judge_verdict"), made_up).alias("injection_resisted"),
        evaluation.bias_safe(F.col("category"), answer, made_up).alias("bias_safe_response"),
    )
    return evaluation.security_summary(records)


def _cited(spark, sf):
    lines = M.read(spark, sf, "lineitem")
    page = F.when(F.col("l_linenumber") == 3, "n/a").otherwise((F.col("l_quantity").cast("int")).cast("string"))
    return lines.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("at"), (F.col("l_suppkey") % 3).cast("string").alias("doc_id"), page.alias("page"))


def _retrieved(spark, sf):
    orders = M.read(spark, sf, "orders")
    start = (F.col("o_custkey") % 20).cast("int")
    return orders.select(F.col("o_orderkey").alias("question_id"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("doc_id"), start.alias("page_start"), (start + 25).alias("page_end"))


_cites = """cited AS (SELECT l_orderkey AS question_id, l_linenumber AS at, (l_suppkey % 3)::VARCHAR AS doc_id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::INT END AS page FROM lineitem),
 got AS (SELECT o_orderkey AS question_id, unnest(['0', '1']) AS doc_id, (o_custkey % 20)::INT AS page_start, (o_custkey % 20)::INT + 25 AS page_end FROM orders)"""


@query(
    "join9_valid_citations",
    f"WITH {_cites} SELECT c.question_id, c.doc_id, c.page::INT AS page, min(c.at)::INT AS at FROM cited c WHERE EXISTS (SELECT 1 FROM got g WHERE g.question_id = c.question_id AND g.doc_id = c.doc_id AND c.page BETWEEN g.page_start AND g.page_end) GROUP BY 1, 2, 3",
)
def join9(spark, sf):
    return evaluation.valid_citations(_cited(spark, sf), _retrieved(spark, sf)).select("question_id", "doc_id", "page", "at")


@query(
    "join10_fabricated",
    f"WITH {_cites} SELECT c.question_id, bool_or(NOT EXISTS (SELECT 1 FROM got g WHERE g.question_id = c.question_id AND g.doc_id = c.doc_id AND c.page BETWEEN g.page_start AND g.page_end)) AS fabricated FROM cited c GROUP BY 1",
)
def join10(spark, sf):
    return evaluation.fabricated(_cited(spark, sf), _retrieved(spark, sf))


def _questions(spark, sf):
    c = M.read(spark, sf, "customer")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("domain-relevant"), F.lit("metrics-generated"), F.lit("novel-generated"), F.lit("other")), (k % 4).cast("int") + 1)
    return c.select(
        F.format_string("q%08d", k).alias("financebench_id"),
        F.col("c_mktsegment").alias("company"),
        (k % 3 + 2021).cast("int").alias("doc_period"),
        F.when(k % 6 == 0, "10q").otherwise("10K").alias("doc_type"),
        kind.alias("question_type"),
        F.when(k % 5 > 0, "reason").alias("question_reasoning"),
        F.when(k % 7 > 0, "link").otherwise(" ").alias("doc_link"),
        (k % 2).cast("int").alias("evidence_count"),
        F.length("c_name").alias("question_length_chars"),
        F.col("c_name").alias("doc_name"),
        F.lower("c_mktsegment").alias("expected_doc_id"),
    )


_questions_sql = """questions AS (SELECT 'q' || lpad(c_custkey::VARCHAR, 8, '0') AS financebench_id, c_mktsegment AS company, (c_custkey % 3 + 2021)::INT AS doc_period, CASE WHEN c_custkey % 6 = 0 THEN '10q' ELSE '10K' END AS doc_type, (c_custkey % 4)::INT AS k,
 ['domain-relevant', 'metrics-generated', 'novel-generated', 'other'][c_custkey % 4 + 1] AS question_type, (c_custkey % 5 = 0)::INT AS no_reason, (c_custkey % 7 = 0)::INT AS no_link, CASE WHEN c_custkey % 7 > 0 THEN 'link' ELSE ' ' END AS doc_link, (c_custkey % 2)::INT AS evidence_count, length(c_name) AS chars FROM customer),
 placed AS (SELECT *, row_number() OVER (PARTITION BY company, doc_period ORDER BY CASE WHEN k = 3 THEN 99 ELSE k END, no_reason, no_link, evidence_count DESC, chars, financebench_id) AS r FROM questions WHERE lower(doc_type) = '10k')"""
_QUOTAS = [("BUILDING", 2022, 3), ("AUTOMOBILE", 2021, 2), ("MACHINERY", 2023, 4)]


@query(
    "win4_quota_subset",
    f"""WITH {_questions_sql}, q(company, doc_period, quota, part) AS (VALUES {', '.join(f"('{c}', {p}, {n}, {i})" for i, (c, p, n) in enumerate(_QUOTAS))})
 SELECT financebench_id, company, doc_period, r::INT AS subset_rank, (row_number() OVER (ORDER BY part, r))::INT AS global_subset_rank FROM placed JOIN q USING (company, doc_period) WHERE r <= quota""",
)
def win4(spark, sf):
    return evaluation.quota_subset(_questions(spark, sf), _QUOTAS, strict=False).select("financebench_id", "company", "doc_period", "subset_rank", "global_subset_rank")


@query(
    "join2_scope_overlap",
    f"""WITH {_questions_sql} SELECT financebench_id, company, doc_period, (row_number() OVER (ORDER BY CASE WHEN k = 3 THEN 99 ELSE k END, no_reason, no_link, evidence_count DESC, chars, financebench_id))::INT AS subset_rank
 FROM questions WHERE lower(doc_type) = '10k' AND (company, doc_period) IN (('BUILDING', 2022), ('FURNITURE', 2021))""",
)
def join2(spark, sf):
    return evaluation.scope_overlap(_questions(spark, sf), [("BUILDING", 2022), ("FURNITURE", 2021)]).select("financebench_id", "company", "doc_period", "subset_rank")


@query(
    "agg8_docs_manifest",
    f"""WITH {_questions_sql} SELECT company, doc_period, doc_type, doc_link, count(*)::BIGINT AS n_questions, array_to_string(list_sort(list(DISTINCT question_type)), ', ') AS question_types, sha256(string_agg(financebench_id, ', ' ORDER BY financebench_id)) AS ids_sha FROM questions GROUP BY 1, 2, 3, 4""",
)
def agg8(spark, sf):
    rows = _questions(spark, sf).withColumns({"doc_name": F.lit(None).cast("string"), "expected_doc_id": F.lit(None).cast("string")})
    out = evaluation.docs_manifest(rows, "financebench_id")
    return out.select("company", "doc_period", "doc_type", "doc_link", "n_questions", "question_types", F.sha2(F.col("financebench_ids").cast("binary"), 256).alias("ids_sha"))


@query(
    "txt12_scope_labels",
    """SELECT company, '`' || company || ' ' || CASE WHEN n >= 2 AND hi - lo + 1 = n THEN lo || '-' || hi ELSE years END || '`' AS label FROM
 (SELECT c_mktsegment || (c_custkey % 40) AS company, count(DISTINCT c_nationkey) AS n, min(c_nationkey) AS lo, max(c_nationkey) AS hi, array_to_string(list_sort(list(DISTINCT c_nationkey)), ', ') AS years FROM customer GROUP BY 1)""",
)
def txt12(spark, sf):
    scope = M.read(spark, sf, "customer").select(F.concat("c_mktsegment", F.col("c_custkey") % 40).alias("company"), F.col("c_nationkey").alias("year"))
    return evaluation.scope_labels(scope)


@query(
    "evl1_questions",
    f"""SELECT sha256({M.strip('text')}) AS question_id, length({M.strip('text')})::INT AS chars, row_number() OVER (ORDER BY item_id)::INT AS question_order FROM benchmark""",
)
def evl1(spark, sf):
    items = M.read(spark, sf, "benchmark").select("item_id", F.col("text").alias("query_text"))
    return evaluation.load_questions(items, "item_id").select("question_id", F.length("question").alias("chars"), "question_order")


@query("flt9_all_pending_questions", "SELECT item_id AS question_id FROM benchmark WHERE item_id % 3 = 1")
def flt9_all(spark, sf):
    items = M.read(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("item_id").alias("question_order"))
    status = F.when(F.col("question_id") % 3 == 0, "success").when(F.col("question_id") % 3 == 1, "error").otherwise("retrieval_only")
    return evaluation.pending_questions(items, items.select("question_id", status.alias("status"))).select("question_id")


@query(
    "evl2_run_records",
    """SELECT o_orderkey AS question_id, count(l_orderkey)::BIGINT AS n_retrieved_chunks, CASE WHEN count(l_orderkey) = 0 THEN '[]' ELSE '["' || string_agg(l_partkey::VARCHAR, '","' ORDER BY l_linenumber, l_partkey::VARCHAR) || '"]' END AS retrieved_chunk_ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def evl2(spark, sf):
    questions = M.read(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"))
    found = M.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end")
    )
    answers = questions.select("question_id", F.lit("x").alias("generated_answer"))
    return evaluation.run_records(questions, found, answers).select("question_id", "n_retrieved_chunks", "retrieved_chunk_ids")


@query("evl6_case_modes", "SELECT item_id, unnest(['rag', 'agent']) AS benchmark_mode FROM benchmark")
def evl6(spark, sf):
    return evaluation.expand_modes(M.read(spark, sf, "benchmark").select("item_id"), "both")


@query(
    "evl8_benchmark_records",
    """SELECT conv_id::VARCHAR AS financebench_id, count(*)::INT AS evidence_count, array_to_string(list_sort(list(DISTINCT (turn % 3)::INT)), '|') AS evidence_pages, arg_min((turn % 3)::INT, turn)::INT AS primary_evidence_page, conv_id || '_2022_10k' AS expected_doc_id FROM conversations GROUP BY conv_id""",
)
def evl8(spark, sf):
    turns = M.read(spark, sf, "conversations")
    part = F.struct("turn", F.lit("d").alias("doc_name"), (F.col("turn") % 3).alias("evidence_page_num"), F.col("text").alias("evidence_text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("evidence"))
    none = ["company", "question_type", "question_reasoning", "question", "answer", "justification", "doc_link", "doc_type", "doc_period"]
    rows = rows.select(F.col("conv_id").cast("string").alias("financebench_id"), F.concat("conv_id", F.lit(" 2022-10K")).alias("doc_name"), "evidence", *[F.lit(None).cast("string").alias(c) for c in none])
    return evaluation.normalize_records(rows).select("financebench_id", "evidence_count", "evidence_pages", "primary_evidence_page", "expected_doc_id")


@query(
    "agg9_upload_summary",
    "SELECT o.o_custkey AS doc_id, count(*)::BIGINT AS page_count, sum(length(o_orderpriority))::BIGINT AS char_count, any_value(coalesce(c.n, 0))::BIGINT AS chunk_count FROM orders o LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) c USING (o_custkey) GROUP BY 1",
)
def agg9(spark, sf):
    orders = M.read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("raw_text"), "o_orderstatus")
    return tables.upload_summary(orders.select("doc_id").distinct(), orders, orders.where("o_orderstatus = 'F'"))


@query("agg13_step_summary", "SELECT source, count(DISTINCT doc_id)::BIGINT AS docs, avg(n_chars)::DOUBLE AS mean, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most FROM documents GROUP BY source")
def agg13(spark, sf):
    c = F.col("n_chars")
    return M.read(spark, sf, "documents").groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"))


@query("agg15_known_chunks", "SELECT count(*)::BIGINT AS chunks FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)")
def agg15(spark, sf):
    labels = M.read(spark, sf, "labels")
    return labels.where("quality = 1").select("doc_id").union(labels.where("toxic = 1").select("doc_id")).agg(F.countDistinct("doc_id").alias("chunks"))


# Events --------------------------------------------------------------------------------------------------------


@query("str3_tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def str3_tumbling(spark, sf):
    out = S.tumbling(M.read(spark, sf, "events"), "1 day")
    return out.withColumn("total", F.round("total", 6))


SQL["str3_tumbling"] = SQL["str3_tumbling"].replace("sum(value) AS total", "round(sum(value), 6) AS total")


@query(
    "str3_sliding",
    "SELECT date_trunc('day', ts) - h * INTERVAL 12 HOUR + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS window_start, event_type, count(*)::BIGINT AS n FROM events, (SELECT unnest([0, 1]) AS h) GROUP BY 1, 2",
)
def str3_sliding(spark, sf):
    return S.tumbling(M.read(spark, sf, "events"), "1 day", "12 hours").drop("total")


@query(
    "str3_sessions",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
 (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true))::INT AS fresh FROM events)) GROUP BY user_id, s""",
)
def str3_sessions(spark, sf):
    return S.sessions(M.read(spark, sf, "events"), "30 minutes")


@query("str2_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def str2(spark, sf):
    return S.latest(M.read(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("win7_minmax", "SELECT event_id, CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE (value - lo) / (hi - lo) END::DOUBLE AS x FROM (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)")
def win7(spark, sf):
    from ..operators.retrieval import normalized

    return M.read(spark, sf, "events").select("event_id", normalized("value", "user_id").alias("x"))
