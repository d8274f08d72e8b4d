"""Retrieval over (query, chunk): filters with fallback, dense, TF-IDF, lexical and staged hybrid ranking.

A batch of queries is one plan. Dense search deals queries to pieces of chunks (see dense_search) and keeps the best rows of
each query. Lexical features are made from postings joined on terms, or only for the candidates that the dense stage left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sections
from ..functions import values as V
from ..functions.text import coverage, slug, stem, terms
from . import dense_search, lexical_search, postings_store, query_terms
from .chunking import navigation
from ..sources.scratch import saved
from .checks import require

K1, B = 1.5, 0.75
#: Chunks whose terms a task of the lexical fallback holds.
FALLBACK_CHUNKS = 5_000


def mode(name: str) -> str:
    """The retrieval mode that a name stands for."""
    low = name.strip().lower()
    for canonical, names in V.MODES.items():
        if low in names:
            return canonical
    raise ValueError(f"unknown retrieval mode: {name}")


# Filters -----------------------------------------------------------------------------------------------------


def inferred_company(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(alias), company) for alias, company in V.COMPANY_ALIASES])


def inferred_year(text: Column) -> Column:
    return F.regexp_extract(text, rf"\b({'|'.join(V.QUERY_YEARS)})\b", 1).try_cast("int")


def with_filters(queries: DataFrame, infer: bool = True) -> DataFrame:
    """Adds company and year of each filter level: explicit ones, and these completed by inferred ones."""
    own = {c: (F.col(c) if c in queries.columns else F.lit(None)) for c in ("company_filter", "fiscal_year_filter")}
    company, year = own["company_filter"].cast("string"), own["fiscal_year_filter"].cast("int")
    out = queries.withColumns({"company_2": company, "year_2": year})
    if not infer:
        return out.withColumns({"company_1": company, "year_1": year})
    text = F.col("query_text")
    return out.withColumns({"company_1": F.coalesce(company, inferred_company(text)), "year_1": F.coalesce(year, inferred_year(text))})


def _uploaded(chunks: DataFrame) -> Column:
    return F.coalesce(F.col("document_source") == "uploaded", F.lit(False)) if "document_source" in chunks.columns else F.lit(False)


def masked(chunks: DataFrame) -> DataFrame:
    """Chunks with the marks uploaded and noisy, which an index already has."""
    made = {"uploaded": lambda: _uploaded(chunks), "noisy": lambda: navigation(F.col("chunk_text"))}
    return chunks.withColumns({c: make() for c, make in made.items() if c not in chunks.columns})


def marked(chunks: DataFrame) -> DataFrame:
    """Marks of chunks beside what filters look at, written once: what several searches read in place of the texts."""
    keep = [c for c in ("company", "fiscal_year", "page_start") if c in chunks.columns]
    return saved(masked(chunks).select("chunk_id", *keep, "uploaded", "noisy"), "marked")


def with_levels(queries: DataFrame, chunks: DataFrame, infer: bool = True, drop_noise: bool = True) -> DataFrame:
    """Adds company, year and drop_noise as they apply to each query: the first of three levels that leaves a chunk.

    Chunks are counted by (company, year), by either and at all; a query looks up the count of its own filter, so the
    work grows with the queries and not with their product with companies and years. Uploaded chunks fit any filter.
    """
    rows = masked(chunks).select(
        F.col("company").alias("c_company"),
        F.col("fiscal_year").cast("int").alias("c_year"),
        F.col("uploaded").alias("c_uploaded"),
        (F.col("noisy") if drop_noise else F.lit(False)).alias("c_noisy"),
    )
    totals = rows.agg(F.struct(F.count("*").alias("every"), F.count_if(F.col("c_uploaded") & ~F.col("c_noisy")).alias("uploaded")).alias("t"))
    groups = rows.where(~F.col("c_uploaded") & ~F.col("c_noisy")).cube("c_company", "c_year")
    own = groups.agg(F.count("*").alias("own"), F.grouping("c_company").alias("any_company"), F.grouping("c_year").alias("any_year"))
    own = own.where("(any_company = 1 OR c_company IS NOT NULL) AND (any_year = 1 OR c_year IS NOT NULL)")
    out = with_filters(queries, infer).withColumn("__total", totals.scalar())
    for level in (1, 2):
        counted = own.select(F.col("c_company").alias("__company"), F.col("c_year").alias("__year"), F.col("own").alias(f"__n{level}"))
        fits = F.col(f"company_{level}").eqNullSafe(F.col("__company")) & F.col(f"year_{level}").eqNullSafe(F.col("__year"))
        out = out.join(counted, fits, "left").drop("__company", "__year")
    n = {i: F.coalesce(f"__n{i}", F.lit(0)) + F.col("__total.uploaded") for i in (1, 2)}
    pick = lambda one, two, three: F.when(n[1] > 0, one).when(n[2] > 0, two).otherwise(three)
    out = out.select(
        *[c for c in queries.columns if c not in ("level", "company", "year", "drop_noise", "n_candidates")],
        pick(F.lit(1), F.lit(2), F.lit(3)).alias("level"),
        pick(F.col("company_1"), F.col("company_2"), F.lit(None)).alias("company"),
        pick(F.col("year_1"), F.col("year_2"), F.lit(None)).alias("year"),
        (pick(F.lit(True), F.lit(True), F.lit(False)) & F.lit(drop_noise)).alias("drop_noise"),
        pick(n[1], n[2], F.col("__total.every")).alias("n_candidates"),
    )
    return out


def _first(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def first_by_filter(rows: DataFrame, keys: list[str], order: list[str], k: int, fixed: list[str] | None = None) -> DataFrame:
    """The first k rows of every filter by the keys, where null stands for any value; rows without a value fit only that.

    Rows are cut to k of each set of values before they are repeated for the filters.
    """
    kinds, fixed = dict(rows.dtypes), fixed or []
    out = _first(rows, keys + fixed, order, k)
    for c in keys:
        out = out.withColumn(c, F.explode(F.array_distinct(F.array(F.lit(None).cast(kinds[c]), F.col(c)))))
    return _first(out, keys + fixed, order, k)


# Dense -------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector has norm 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return dot(a, b) / (norm(a) * norm(b))


def dense(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k chunks nearest to each query: (query_id, key, score, rank). Ties by key.

    ``queries`` has query_id and embedding, and optionally company, year and drop_noise to filter by; ``chunks`` then
    has company, fiscal_year, uploaded and noisy. Scores are rounded to nine places, so summation order decides nothing.
    Chunks without a key or a vector, and queries without a vector, are left out. See :mod:`.dense_search`: exact, with pieces of chunks
    that a query needn't see left out.
    """
    filtered = "drop_noise" in queries.columns
    return dense_search.search(dense_search.place(chunks, key, filtered), queries, k)[0]


def index(chunks: DataFrame, embeddings: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks with their vectors and masks: what a search reads. Written to Parquet it is a persistent index."""
    if model is not None:
        embeddings = embeddings.where(F.col("embedding_model") == model)
    # Marked before the join, so that who reads no text shuffles none.
    marked = chunks.withColumns({"uploaded": _uploaded(chunks), "noisy": navigation(F.col("chunk_text"))})
    return marked.join(require(embeddings, ["chunk_id", "embedding"]).select("chunk_id", "embedding"), "chunk_id")


def marks(indexed: DataFrame) -> DataFrame:
    """What filters and dense search look at of an index, written once: the counts of filters, the pieces and the search read no text."""
    return saved(indexed.select("chunk_id", "embedding", *dense_search.FILTERS), "marks")


def query_vectors(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Vectors by the hash of the text, else by the text itself; queries without one are left out.

    Texts are compared by their SHA-256, so the shuffles carry digests; a text is moved only if the caller reads it.
    """
    from ..functions.text import content_hash

    same = F.sha2(F.col("query_text").cast("binary"), 256)
    asked = queries.withColumns({"__hash": content_hash(F.col("query_text")), "__text": same})
    by_id = cache.select(F.col("query_id").alias("__hash"), F.col("embedding").alias("__one"))
    by_text = cache.groupBy(same.alias("__text")).agg(F.max_by("embedding", "query_id").alias("__two"))
    out = asked.join(by_id, "__hash", "left").join(by_text, "__text", "left")
    found = out.withColumn("embedding", F.coalesce("__one", "__two")).where("embedding IS NOT NULL")
    return found.select(*[c for c in queries.columns if c != "embedding"], "embedding")


# Lexical -----------------------------------------------------------------------------------------------------


def exploded_terms(df: DataFrame, keys: list[str], text: Column, drop_stopwords: bool = False) -> DataFrame:
    """One row for each term of the text, stemmed after the explode, inside generated code."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9'\-]*"), F.lit(0))
    out = df.select(*keys, F.explode(raw).alias("raw")).select(*keys, stem(F.col("raw")).alias("term"))
    keep = (F.length("term") >= 3) | F.col("term").isin(V.SHORT_TOKENS)
    if drop_stopwords:
        keep = keep & (~F.col("term").isin(V.STOPWORDS) | F.col("term").isin(V.SHORT_TOKENS))
    return out.where(keep)


def postings(df: DataFrame, keys: list[str], text: Column, drop_stopwords: bool = False) -> DataFrame:
    return exploded_terms(df, keys, text, drop_stopwords).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n: DataFrame | int) -> DataFrame:
    """(term, idf) of (term, df) among n chunks; n is a number or a table of one."""
    counted = df.withColumn("n", F.lit(n) if isinstance(n, int) else n.scalar())
    return counted.select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf(chunks: DataFrame | postings_store.Lexical, queries: DataFrame, k: int) -> DataFrame:
    """TF-IDF cosine: (query_id, chunk_id, score, rank). Chunks without a common term score 0.

    ``chunks`` are chunks, or an index of them. Statistics are those of the whole corpus. Queries with company, year and drop_noise
    (see :func:`with_levels`) only find chunks that fit these.
    """
    index = chunks if isinstance(chunks, postings_store.Lexical) else postings_store.of_chunks(chunks)
    n = index.chunks.agg(F.count("*")) if index.n is None else index.n
    idfs = idf(index.df, n)
    norms = postings_store.norms(index.postings, index.df, n) if index.norms is None else index.norms
    weight = (1.0 + F.log("tf")) * F.col("idf")
    asked = postings(queries, ["query_id"], F.col("query_text"), True).join(idfs, "term").select("query_id", "term", weight.alias("qw"), "idf")
    # Read three times: its norms, its terms, and its rows.
    asked = saved(asked, "asked")
    qnorms = asked.groupBy("query_id").agg(F.greatest(F.sqrt(F.sum(F.col("qw") * F.col("qw"))), F.lit(1e-12)).alias("qnorm"))
    weighted = asked.join(qnorms, "query_id").select("query_id", "term", (F.col("qw") * F.col("idf")).alias("weight"), "qnorm")
    # Only the terms that are asked for go on.
    posted = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    size = index.chunks.count() if index.n is None else index.n
    filters = queries.select("query_id", *[c for c in ("company", "year", "drop_noise") if c in queries.columns])
    scored = lexical_search.search(posted, index.chunks, norms, weighted, filters, k, size, asked.select("query_id").distinct().count())
    return ranked(filled(scored, index.chunks, queries, k), k)


def filled(scored: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Adds the first k chunks by id with score 0, of those that fit the query, for queries that match fewer than k."""
    if "drop_noise" in queries.columns:
        zero = _fitting(chunks, queries, k)
    else:
        first = chunks.select("chunk_id").orderBy("chunk_id").limit(k).agg(F.collect_list("chunk_id")).scalar()
        zero = queries.select("query_id", F.explode(first).alias("chunk_id"))
    both = scored.select("query_id", "chunk_id", "score").unionByName(zero.withColumn("score", F.lit(0.0)))
    return both.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def _fitting(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k chunks by id that fit each query's filters; lists of at most k ids meet a query by its filter."""
    ready = chunks if {"uploaded", "noisy"} <= set(chunks.columns) else masked(chunks)
    marked = ready.select("chunk_id", F.col("company").alias("c_company"), F.col("fiscal_year").cast("int").alias("c_year"), "uploaded", "noisy")
    kinds = F.when(~F.col("noisy"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = marked.withColumn("c_drop", F.explode(kinds)).drop("noisy")
    own = first_by_filter(rows.where("NOT uploaded").drop("uploaded"), ["c_company", "c_year"], ["chunk_id"], k, ["c_drop"])
    own = own.groupBy("c_company", "c_year", "c_drop").agg(F.collect_list("chunk_id").alias("own"))
    every = _first(rows.where("uploaded").select("chunk_id", "c_drop"), ["c_drop"], ["chunk_id"], k)
    every = every.groupBy(F.col("c_drop").alias("u_drop")).agg(F.collect_list("chunk_id").alias("everywhere"))
    asked = queries.select("query_id", "company", "year", "drop_noise")
    fits = F.col("company").eqNullSafe(F.col("c_company")) & F.col("year").eqNullSafe(F.col("c_year")) & (F.col("drop_noise") == F.col("c_drop"))
    both = asked.join(own, fits, "left").join(every, F.col("drop_noise") == F.col("u_drop"), "left")
    none = F.array().cast(f"array<{dict(chunks.dtypes)['chunk_id']}>")
    ids = F.concat(F.coalesce("own", none), F.coalesce("everywhere", none))
    return both.select("query_id", F.explode(F.slice(F.array_sort(F.array_distinct(ids)), 1, k)).alias("chunk_id"))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, wanted, counts): the distinct terms of each query that has any, in order, and how often it says them."""
    said = postings(queries, ["query_id"], F.col("query_text"), True).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("said"))
    return said.select("query_id", F.col("said.term").alias("wanted"), F.col("said.tf").alias("counts"))


def bm25_score(cut: DataFrame, asked: DataFrame) -> DataFrame:
    """Adds bm25_score to rows with query_id, dl and hits (see query_terms), with statistics over a query's own rows.

    ``cut`` is read three times. Only counts go through shuffles beside the rows, which meet their query's weights once.
    """
    stats = cut.groupBy("query_id").agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("average"))
    df = cut.select("query_id", F.explode("hits.at").alias("at")).groupBy("query_id", "at").agg(F.count("*").alias("df"))
    terms_ = asked.select("query_id", F.posexplode("counts").alias("at", "qtf")).join(stats, "query_id").join(df, ["query_id", "at"], "left")
    seen = F.coalesce("df", F.lit(0))
    weight = F.col("qtf") * F.log(1.0 + (F.col("n") - seen + 0.5) / (seen + 0.5))
    weights = terms_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", weight.alias("w")))).alias("__w"), F.first("average").alias("__average"))
    weights = weights.select("query_id", F.col("__w.w").alias("__weights"), "__average")
    longer = K1 * (1.0 - B + B * F.col("dl") / F.col("__average"))
    out = cut.join(weights, "query_id", "left").withColumn("__longer", longer)
    score = F.aggregate("hits", F.lit(0.0), lambda s, h: s + F.col("__weights")[h["at"]] * (h["tf"] * (K1 + 1.0) / (h["tf"] + F.col("__longer"))))
    return out.withColumn("bm25_score", F.coalesce(score, F.lit(0.0))).drop("__weights", "__average", "__longer", "dl", "hits")


def bm25(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 of each (query_id, chunk_id, text), with statistics over a query's own candidates: adds bm25_score."""
    asked = saved(asked_terms(queries), "asked")
    rows = query_terms.counted(pairs.select("query_id", "chunk_id", "text").join(asked.drop("counts"), "query_id", "left"), "wanted", "text")
    return bm25_score(saved(rows.select("query_id", "chunk_id", "dl", "hits"), "cut"), asked)


def lexical_fallback(chunks: DataFrame | postings_store.Lexical, queries: DataFrame, k: int) -> DataFrame:
    """Overlap and coverage only, with loose company and exact year filters where a query has them.

    ``chunks`` are chunks, or an index of them. A query's share of found terms comes from postings; chunks without any term fill up to k
    in page order.
    """
    index = chunks if isinstance(chunks, postings_store.Lexical) else postings_store.of_chunks(chunks)
    own = lambda c, t: (F.col(c) if c in queries.columns else F.lit(None)).cast(t)
    asked = queries.select("query_id", "query_text", slug(own("company_filter", "string")).alias("q_company"), own("fiscal_year_filter", "int").alias("q_year"))
    asked = asked.withColumn("q_company", F.nullif("q_company", F.lit("")))
    wanted = saved(exploded_terms(asked, ["query_id"], F.col("query_text"), True).distinct(), "wanted")
    size = wanted.groupBy("query_id").agg(F.count("*").alias("wanted"))
    # A query has no stopwords, so postings needn't have any. The same term counts once in a chunk.
    posted = index.postings.join(wanted.select("term").distinct(), "term", "left_semi").withColumn("tf", F.lit(1))
    year = F.col("fiscal_year").try_cast("int").alias("fiscal_year")
    loose = index.chunks.select("chunk_id", slug(F.col("company")).alias("company"), year, F.lit(False).alias("uploaded"), F.lit(False).alias("noisy"), F.col("page_start").alias("place"))
    said = wanted.join(size, "query_id").select("query_id", "term", F.lit(1.0).alias("weight"), F.col("wanted").cast("double").alias("qnorm"))
    filters = asked.select("query_id", F.col("q_company").alias("company"), F.col("q_year").alias("year"), F.lit(False).alias("drop_noise"))
    n = index.chunks.count() if index.n is None else index.n
    # Pairs of query and chunk are counted and cut to the best where they meet: only terms that are asked for are shuffled.
    found = lexical_search.search(posted, loose, None, said, filters, k, n, size.count(), FALLBACK_CHUNKS)
    share = F.round(F.col("score") * F.col("wanted")) / F.col("wanted")
    scored = found.join(index.chunks.select("chunk_id", "page_start"), "chunk_id").join(size, "query_id").select("query_id", "chunk_id", "page_start", share.alias("lexical_score"))
    spare = index.chunks.select(slug(F.col("company")).alias("c_company"), F.col("fiscal_year").try_cast("int").alias("c_year"), "chunk_id", "page_start")
    spare = first_by_filter(spare, ["c_company", "c_year"], ["page_start", "chunk_id"], k)
    fits = F.col("q_company").eqNullSafe(F.col("c_company")) & F.col("q_year").eqNullSafe(F.col("c_year"))
    fill = asked.join(spare, fits).select("query_id", "chunk_id", "page_start", F.lit(0.0).alias("lexical_score"))
    both = scored.unionByName(fill).groupBy("query_id", "chunk_id", "page_start").agg(F.max("lexical_score").alias("lexical_score"))
    final = F.round(0.65 * F.col("lexical_score") + 0.35 * F.col("lexical_score"), 9)
    both = both.withColumns({"coverage_score": F.col("lexical_score"), "final_score": final})
    order = [F.desc("final_score"), F.desc("lexical_score"), F.asc("page_start"), F.asc("chunk_id")]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return both.withColumn("rank", place).where(F.col("rank") <= k)


# Hybrid ------------------------------------------------------------------------------------------------------


def intents(text: Column) -> Column:
    """What a query asks about, in fixed order."""
    low = F.lower(text)

    def says(name: str, needles: list[str]) -> Column:
        found = F.lit(False)
        for n in needles:
            found = found | low.contains(n)
        if name == "ai":
            found = found | F.concat(F.lit(" "), low, F.lit(" ")).contains(" ai ")
        return F.when(found, name)

    return F.array_compact(F.array(*[says(n, w) for n, w in V.INTENTS.items()]))


def normalized(column: str, by: str = "query_id") -> Column:
    """Min-max over a query's rows; rows all alike become 1 where positive and 0 elsewhere."""
    rows = Window.partitionBy(by)
    value, low, high = F.col(column), F.min(column).over(rows), F.max(column).over(rows)
    flat = F.abs(high - low) <= 1e-8 + 1e-5 * F.abs(low)
    return F.when(flat, F.when(value > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def section_score(asked: Column, text: Column, group: Column) -> Column:
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    best = F.greatest(sections.intent_patterns(asked, F.coalesce(text, F.lit(""))), sections.weight(asked, group, V.WANTED))
    return F.when(blank, 0.0).otherwise(best)


def section_penalty(asked: Column, group: Column) -> Column:
    return sections.weight(asked, group, V.UNWANTED)


def header_score(query_terms: Column, text: Column, title: Column) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), F.trim), lambda x: x != "")
    head = F.array_join(F.slice(lines, 1, 6), "\n")
    return coverage(query_terms, terms(F.concat_ws("\n", F.nullif(title, F.lit("")), head)))


def numeric_penalty(asked: Column, text: Column, group: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    digits = F.length(F.regexp_replace(text, r"\P{Nd}", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    ratio = digits / F.greatest(F.lit(1), digits + letters)
    part = F.when(ratio > 0.18, F.least(F.lit(0.35), (ratio - 0.18) * 1.5)).otherwise(0.0)
    part = F.when(F.coalesce(group == "financial_statements", F.lit(False)), F.greatest(part, F.lit(0.35))).otherwise(part)
    return F.when(F.array_contains(asked, "financial_metrics") | (digits == 0), 0.0).otherwise(F.least(F.lit(0.60), part))


def relation_score(query: Column, asked: Column, relations: Column) -> Column:
    """How well a chunk's relations fit the question."""
    has = F.transform(F.coalesce(relations, F.array().cast("array<string>")), lambda r: F.upper(F.trim(r)))
    low = F.lower(query)
    rules = [F.when(F.array_contains(asked, i) & F.array_contains(has, r), s) for r, i, s in V.RELATION_BY_INTENT]
    for r, needles, s in V.RELATION_BY_WORD:
        said = F.lit(False)
        for n in needles:
            said = said | low.contains(n)
        rules.append(F.when(said & F.array_contains(has, r), s))
    return F.coalesce(F.greatest(*rules), F.lit(0.0))


def pools(k: int, pool: int | None = None) -> tuple[int, int]:
    """Sizes of the dense pool and of the preliminary one (a query with fewer candidates keeps all it has)."""
    pool = max(k * 8, 30) if pool is None else pool
    return max(pool * 4, k * 24, 120), max(pool * 2, k * 12, 60)


def hybrid(
    indexed: DataFrame,
    queries: DataFrame,
    k: int,
    facts: DataFrame | None = None,
    rerank: bool = True,
    lexical: bool = True,
    pool: int | None = None,
    ready: DataFrame | None = None,
) -> DataFrame:
    """Three stages: dense pool under the filters, preliminary rank, reranking; (query_id, chunk_id, scores, rank).

    Scores are normalised over the rows of their own stage. ``indexed`` comes from :func:`index`; where its :func:`marks` are ``ready``, only
    the texts of chunks are read of it.
    """
    dense_size, second_size = pools(k, pool)
    ready = marks(indexed) if ready is None else ready
    asked = with_levels(queries, ready)
    near = dense(ready, asked, dense_size).drop("rank")
    keep = ["chunk_id", "chunk_text", *(c for c in ("section_title", "section_group") if c in indexed.columns)]
    rows = near.join(indexed.select(*keep), "chunk_id")
    for c in ("section_title", "section_group"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    wanted = saved(asked_terms(queries), "asked")
    none = F.array().cast("array<string>")
    said = queries.select("query_id", "query_text", intents(F.col("query_text")).alias("asked")).join(wanted.drop("counts"), "query_id", "left")
    said = said.withColumn("q_terms", F.coalesce("wanted", none)).drop("wanted")
    # Texts are cut into terms once, before the pool is written; statistics then read counts alone.
    rows = saved(query_terms.counted(rows.join(said, "query_id"), "q_terms", "chunk_text", "section_title"), "pool")
    if facts is not None:
        rows = rows.join(facts.select("chunk_id", "knowledge_text", "knowledge_relations"), "chunk_id", "left")
    else:
        rows = rows.withColumns({"knowledge_text": F.lit(""), "knowledge_relations": F.array().cast("array<string>")})
    known = coverage(F.col("q_terms"), terms(F.col("knowledge_text")))
    fits = relation_score(F.col("query_text"), F.col("asked"), F.col("knowledge_relations"))
    rows = rows.withColumns(
        {
            "coverage_score": F.when(F.size("q_terms") == 0, 0.0).otherwise(F.col("covered") / F.size("q_terms")),
            "knowledge_coverage_score": known,
            "knowledge_relation_score": fits,
        }
    )
    rows = rows.withColumns(
        {
            "knowledge_score": F.least(F.lit(1.0), 0.70 * F.col("knowledge_coverage_score") + 0.30 * F.col("knowledge_relation_score")),
        }
    )
    if lexical:
        rows = bm25_score(rows, wanted).drop("covered")
    else:
        rows = rows.withColumn("bm25_score", F.lit(0.0)).drop("covered", "dl", "hits")
    first = 0.55 * normalized("score") + 0.30 * normalized("bm25_score") + 0.15 * F.col("coverage_score") + 0.08 * F.col("knowledge_score")
    rows = ordered(rows.withColumn("preliminary_score", F.round(first, 9)), "preliminary_score", second_size).drop("rank")
    rows = rows.withColumns(
        {
            "section_score": section_score(F.col("asked"), F.col("chunk_text"), F.col("section_group")),
            "section_penalty": section_penalty(F.col("asked"), F.col("section_group")),
            "header_score": header_score(F.col("q_terms"), F.col("chunk_text"), F.col("section_title")),
            "numeric_penalty": numeric_penalty(F.col("asked"), F.col("chunk_text"), F.col("section_group")),
            "lexical_score": F.col("coverage_score"),
        }
    )
    c = F.col
    if lexical:
        mixed = 0.48 * normalized("score") + 0.27 * normalized("bm25_score") + 0.15 * c("coverage_score") + 0.20 * c("section_score") - 0.15 * c("section_penalty")
    else:
        mixed = 0.75 * normalized("score") + 0.25 * c("section_score") - 0.15 * c("section_penalty")
    rows = rows.withColumn("hybrid_score", mixed + 0.08 * c("knowledge_score"))
    if not rerank:
        again = c("hybrid_score")
    elif lexical:
        again = (
            0.30 * c("hybrid_score") + 0.18 * c("coverage_score") + 0.24 * c("section_score") + 0.12 * c("header_score")
            + 0.10 * normalized("lexical_score") + 0.10 * normalized("bm25_score") - 0.10 * c("numeric_penalty") - 0.15 * c("section_penalty")
            + 0.10 * c("knowledge_score")
        )
    else:
        again = (
            0.60 * c("hybrid_score") + 0.25 * c("section_score") + 0.10 * c("header_score") - 0.10 * c("numeric_penalty")
            - 0.15 * c("section_penalty") + 0.10 * c("knowledge_score")
        )
    rows = ordered(rows.withColumn("rerank_score", F.round(again, 9)), "rerank_score", k)
    return rows.withColumn("final_score", c("rerank_score")).drop("q_terms", "asked", "query_text", "knowledge_text", "knowledge_relations")


def ordered(rows: DataFrame, score: str, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= n)


SCORES = [
    "lexical_score", "coverage_score", "section_score", "section_penalty", "header_score", "numeric_penalty", "knowledge_score", "knowledge_coverage_score",
    "knowledge_relation_score", "bm25_score", "preliminary_score", "hybrid_score", "rerank_score",
]


def baseline_schema(found: DataFrame, name: str) -> DataFrame:
    """The columns of a full result around a plain score."""
    return found.withColumns({c: F.lit(0.0) for c in SCORES} | {"final_score": F.col("score"), "retrieval_mode": F.lit(name)})


def results(found: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """Any mode's results in one schema: query, chunk, scores and mode, then the chunk's own columns."""
    scores = ["query_id", "chunk_id", "rank", "score", *SCORES, "final_score"]
    own = [c for c in chunks.columns if c == "chunk_id" or c not in (*scores, "embedding", "uploaded", "noisy", "retrieval_mode")]
    return found.select(*scores, F.lit(name).alias("retrieval_mode")).join(chunks.select(*own), "chunk_id")


def retrieve(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, name: str = "improved", facts: DataFrame | None = None) -> DataFrame:
    """Top k in any mode, under any of its names, under the queries' filters; all modes give the same columns."""
    return retrieve_all(chunks, embeddings, queries, k, [name], facts)


def retrieve_all(chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, names: list[str], facts: DataFrame | None = None) -> DataFrame:
    """:func:`retrieve` in several modes. Chunks are marked once, vectors meet their marks once, and queries that several modes read are written."""
    modes, seen = [mode(n) for n in names], marked(chunks)
    asked, ready, out = queries if len(modes) == 1 else saved(queries, "queries"), None, None
    for canonical in modes:
        if canonical == "classical_ml":
            found = tfidf(postings_store.of_chunks(chunks, seen), with_levels(asked, seen), k)
        else:
            ready = marks(seen.join(require(embeddings, ["chunk_id", "embedding"]).select("chunk_id", "embedding"), "chunk_id")) if ready is None else ready
            # Of the chunks' own texts only those of a pool are read, and all of that have a vector.
            found = dense(ready, with_levels(asked, ready), k) if canonical == "naive" else hybrid(chunks, asked, k, facts, ready=ready)
        one = results(found if canonical == "improved" else baseline_schema(found, canonical), chunks, canonical)
        out = one if out is None else out.union(one)
    return out
