"""Extracted entities and relations: validation, facts of chunks, competitors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import any_of, hits, let, needed, preview, squeeze, strip, title_case, word_count
from ..sources.scratch import saved
from . import items
from .incremental import keep_first


def _lookup(text: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), text)


def _text(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def confidence(value: Column) -> Column:
    number = F.trim(value.cast("string")).try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))


def entity_type(value: Column) -> Column:
    return _lookup(F.lower(_text(value)), V.ENTITY_TYPES)


def _is_entity(low: Column, kind: Column) -> Column:
    bad = (
        ((kind == "product") & low.isin(V.NOT_PRODUCTS))
        | ((kind == "financial_metric") & low.isin(V.NOT_METRICS))
        | ((kind == "executive") & low.isin(V.NOT_EXECUTIVES))
    )
    return ~bad & (F.length(low) > 1)


def is_entity(text: Column, kind: Column) -> Column:
    return _is_entity(F.lower(strip(text)), kind)


def first_items(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items of an array whose key (a text) is met for the first time, in order.

    Keys are sorted with their places, so each is compared with the one before only: n log n, whatever the array's size.
    """
    keyed = lambda xs: F.transform(xs, lambda x, i: F.struct(key(x).alias("key"), i.alias("at")))
    once = lambda ks: F.filter(ks, lambda k, i: (i == 0) | ~k["key"].eqNullSafe(ks[F.greatest(i - 1, F.lit(0))]["key"]))
    places = lambda xs: let(F.sort_array(keyed(xs)), lambda ks: F.sort_array(F.transform(once(ks), lambda k: k["at"])))
    return let(items, lambda xs: F.transform(places(xs), lambda at: xs[at]))


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each key by ordinal: facts of several responses of a chunk are one. Rows alike in ordinal are decided by a hash."""
    rest = [c for c in rows.columns if c not in (*key, "ordinal")]
    return keep_first(rows, key, ["ordinal", F.xxhash64(*rest)]).select(*[c for c in rows.columns if not c.startswith("__")])


def _split(responses: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Responses of chunks that have one, and of chunks that have several (null is a chunk as well), if there are any.

    Only ids are counted, and those met again are stored, so Spark sees how few they are. ``responses`` is read more than once: what a
    model said should be stored, not asked for again.
    """
    again = saved(responses.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("__again")), "again")
    if again.isEmpty():
        return responses, None
    same = F.col("chunk_id").eqNullSafe(F.col("__again"))
    return responses.join(again, same, "left_anti"), responses.join(again, same, "left_semi")


def _rows(responses: DataFrame, make: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """What ``make`` gives, once by key. A response's items are distinct in their array; only chunks with several responses are shuffled."""
    one, more = _split(responses)
    out = make(one)
    out = out.select(*[c for c in out.columns if not c.startswith("__")])
    return out if more is None else out.unionByName(_once(make(more), key))


def entities(responses: DataFrame) -> DataFrame:
    """From (chunk_id, doc_id, company, fiscal_year, page_start, page_end, response JSON): valid entities, once a chunk.

    Items are cleaned, checked and made distinct inside their array (see :mod:`.items`); those that a chunk's other responses repeat (a chunk
    joined twice, a response given again) are found by an aggregate over such chunks, which combines before its shuffle.
    """

    def make(answers: DataFrame) -> DataFrame:
        return items.found(answers).select("*", F.explode("found").alias("item")).select(
            "chunk_id",
            F.col("item.low").alias("__low"),
            F.col("item.text").alias("entity_text"),
            F.col("item.kind").alias("entity_type"),
            confidence(F.col("item.confidence")).alias("confidence"),
            F.col("doc_id").alias("source_doc_id"),
            F.col("fiscal_year").cast("int").alias("year"),
            "company",
            "page_start",
            "page_end",
            F.col("item.ordinal").alias("ordinal"),
        )

    return _rows(responses, make, ["chunk_id", "entity_type", "__low"])


def relation(value: Column) -> Column:
    name = F.upper(_text(value))
    return F.when(name.isin(V.RELATIONS), name).otherwise(_lookup(name, V.RELATION_ALIASES))


def is_person(text: Column) -> Column:
    n = word_count(text)
    return n.between(2, 5) & ~strip(text).rlike(r"(^|[\s\p{Z}])[^\p{Lu}\s\p{Z}]")


def is_metric(text: Column) -> Column:
    return any_of(F.lower(text), V.METRIC_SIGNALS)


def is_triplet(a: Column, name: Column, b: Column) -> Column:
    low_a, low_b = F.lower(a), F.lower(b)
    ends = (F.length(a) >= 2) & (F.length(b) >= 2) & ~low_a.isin(V.GENERIC_ENDS) & ~low_b.isin(V.GENERIC_ENDS) & (low_a != low_b)
    offers = (name != "OFFERS") | (~low_b.isin(V.NOT_OFFERS) & (word_count(b) <= 8))
    leads = (name != "LEADS_BY") | (~low_b.isin(V.NOT_LEADERS) & ~any_of(low_b, V.NOT_LEADER_PATTERNS) & is_person(b))
    reports = (name != "REPORTS") | is_metric(b)
    return name.isNotNull() & ends & offers & leads & reports


def triplets(responses: DataFrame) -> DataFrame:
    """From (chunk_id, doc_id, company, fiscal_year, page_start, page_end, response JSON): valid relations, once a chunk.

    Made distinct as entities are.
    """

    def make(answers: DataFrame) -> DataFrame:
        return items.related(answers).select("*", F.explode("related").alias("item")).select(
            "chunk_id",
            F.col("item.low_a").alias("__a"),
            F.col("item.low_b").alias("__b"),
            F.col("item.a").alias("entity_a"),
            F.col("item.name").alias("relation"),
            F.col("item.b").alias("entity_b"),
            F.col("fiscal_year").cast("int").alias("year"),
            "company",
            "doc_id",
            "page_start",
            "page_end",
            F.col("item.ordinal").alias("ordinal"),
        )

    return _rows(responses, make, ["chunk_id", "relation", "__a", "__b"])


def _texts(text: Column, name: str, order: str = "ordinal") -> Column:
    """Aggregate: a group's texts in order, stripped, non-empty, once whatever their case: the first spelling stays."""
    text = _text(text)
    rows = F.array_sort(F.collect_list(F.when(text != "", F.struct(F.col(order).alias("at"), text.alias("text")))))
    return F.transform(first_items(rows, lambda x: F.lower(x["text"])), lambda x: x["text"]).alias(name)


def triplet_label(a: Column, name: Column, b: Column) -> Column:
    a, name, b = _text(a), _text(name), _text(b)
    return F.when((a == "") | (name == "") | (b == ""), "").otherwise(F.concat(a, F.lit(" ["), name, F.lit("] "), b))


def chunk_facts(found: DataFrame, related: DataFrame) -> DataFrame:
    """What was extracted from each chunk, from either side."""
    label = triplet_label(F.col("entity_a"), F.col("relation"), F.col("entity_b"))
    one = found.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(
        _texts(F.col("entity_text"), "knowledge_entities"), _texts(F.col("entity_type"), "knowledge_entity_types")
    )
    rival = F.when(F.col("relation") == "COMPETES_WITH", F.col("entity_b"))
    two = related.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(
        _texts(label, "knowledge_triplets"), _texts(F.col("relation"), "knowledge_relations"), _texts(rival, "knowledge_competitors")
    )
    return _with_counts(one.join(two, "chunk_id", "full"))


def _with_counts(out: DataFrame) -> DataFrame:
    lists = ["knowledge_entities", "knowledge_entity_types", "knowledge_triplets", "knowledge_relations", "knowledge_competitors"]
    out = out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})
    return out.select(
        "chunk_id",
        F.size("knowledge_entities").alias("entity_count"),
        F.size("knowledge_triplets").alias("triplet_count"),
        *lists,
        F.array_join(F.concat("knowledge_entities", "knowledge_triplets", "knowledge_competitors"), " ").alias("knowledge_text"),
        F.array_join(F.slice("knowledge_entities", 1, 5), " | ").alias("knowledge_entities_preview"),
        F.array_join(F.slice("knowledge_triplets", 1, 4), " | ").alias("knowledge_triplets_preview"),
    )


def response_facts(responses: DataFrame) -> DataFrame:
    """Facts of chunks, as :func:`chunk_facts` gives them, from responses that hold entities and triplets.

    A chunk with one response has all it needs in a row, so nothing is shuffled; others go by :func:`chunk_facts`.
    """
    one, more = _split(responses)
    rows = items.lists(one.where("chunk_id IS NOT NULL").select("chunk_id", "response"))
    made = rows.where((F.size("knowledge_entities") > 0) | (F.size("knowledge_triplets") > 0))
    out = _with_counts(made)
    return out if more is None else out.unionByName(chunk_facts(entities(more), triplets(more)))


def with_facts(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts beside chunks; without facts counts are 0, texts empty and lists empty (types stay null)."""
    out = chunks.join(facts, "chunk_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("entity_count", "triplet_count")}
        | {c: F.coalesce(c, F.lit("")) for c in ("knowledge_text", "knowledge_entities_preview", "knowledge_triplets_preview")}
        | {c: F.coalesce(c, none) for c in ("knowledge_entities", "knowledge_triplets", "knowledge_relations", "knowledge_competitors")}
    )


# Competitors ------------------------------------------------------------------------------------------------


def _low(text: Column) -> Column:
    return F.lower(squeeze(text))


def _canonical(low: Column, otherwise: Column) -> Column:
    out = otherwise
    for company, others in V.SOURCE_ALIASES.items():
        out = F.when(low.isin([company, *others]), company).otherwise(out)
    return out


def source_company(name: Column) -> Column:
    return let(_low(name), lambda low: _canonical(low, low))


def _name(low: Column, text: Column) -> Column:
    def bare(low: Column) -> Column:
        out = low
        for suffix in V.LEGAL_SUFFIXES:
            out = strip(F.regexp_replace(out, f"(?i){suffix}", ""))
        # Every suffix follows a blank, so most names are told by that.
        return F.when(low.contains(" ") & any_of(low, [f"(?i){s}" for s in V.LEGAL_SUFFIXES]), squeeze(out)).otherwise(low)

    title = let(bare(low), lambda x: F.when(x == "", squeeze(text)).otherwise(title_case(x)))
    return _canonical(low, title)


def competitor_name(text: Column) -> Column:
    """Source companies by their own name; others without legal suffixes, in title case."""
    return let(_low(text), lambda low: _name(low, text))


def _same(low: Column, own: Column) -> Column:
    out = low == own
    for name, others in V.SOURCE_ALIASES.items():
        out = out | ((own == name) & low.isin([name, *others]))
    return out


def is_self(text: Column, company: Column) -> Column:
    return let(_low(text), lambda low: let(source_company(company), lambda own: _same(low, own)))


def is_name(text: Column) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) >= 2) & ~_low(text).isin(V.GENERIC_NAMES)


def _blacklisted(low: Column) -> Column:
    return low.isin(V.NOT_COMPETITORS) | (hits(low, V.NOT_COMPETITOR_PATTERNS, needed(V.NOT_COMPETITOR_PATTERNS)) > 0)


def is_blacklisted(name: Column) -> Column:
    return let(_low(name), _blacklisted)


def _generic(low: Column) -> Column:
    return (word_count(low) > 8) | (hits(low, V.GENERIC_NAME_PATTERNS, needed(V.GENERIC_NAME_PATTERNS)) >= 2)


def is_generic(name: Column) -> Column:
    return let(_low(name), _generic)


def has_signal(text: Column) -> Column:
    return any_of(_low(text), V.COMPETITION_SIGNALS)


MENTION = [
    "chunk_id", "source_doc_id", "source_company", "year", "competitor_name", "page_start", "page_end", "has_competition_risk_signal",
    "explicit_competes_with", "mention_source",
]


def mentions(found: DataFrame, related: DataFrame, chunks: DataFrame) -> DataFrame:
    """Competitor mentions from company entities (in their chunk) and from relations, once by key and source."""

    def named(rows: DataFrame, text: Column) -> DataFrame:
        # From a Generate, so that filters by the name don't compute it again.
        return rows.withColumn("competitor_name", F.explode(F.array(competitor_name(text))))

    companies = found.where("entity_type = 'company'").drop("page_start", "page_end")
    # A chunk's text is looked at once, not beside each of its entities.
    signals = chunks.select("chunk_id", has_signal(F.coalesce("chunk_text", F.lit(""))).alias("__signal"), "page_start", "page_end")
    inside = named(companies, F.col("entity_text")).join(signals, "chunk_id", "left")
    one = inside.withColumns(
        {
            "source_company": source_company(F.col("company")),
            "has_competition_risk_signal": F.coalesce("__signal", F.lit(False)),
            "explicit_competes_with": F.lit(False),
            "mention_source": F.lit("entity"),
        }
    ).where(~is_self(F.col("entity_text"), F.col("source_company")) & is_name(F.col("entity_text")))
    two = (
        named(related.where("relation = 'COMPETES_WITH'"), F.col("entity_b"))
        .withColumns(
            {
                "source_company": source_company(F.col("company")),
                "source_doc_id": F.col("doc_id"),
                "has_competition_risk_signal": F.lit(True),
                "explicit_competes_with": F.lit(True),
                "mention_source": F.lit("triplet"),
            }
        )
        .where(~is_self(F.col("competitor_name"), F.col("source_company")) & is_name(F.col("competitor_name")))
    )
    both = one.select(*MENTION, "ordinal").unionByName(two.select(*MENTION, "ordinal"))
    good = both.where(~is_blacklisted(F.col("competitor_name")) & ~is_generic(F.col("competitor_name")))
    key = ["chunk_id", "source_company", "year", "competitor_name", "mention_source"]
    return keep_first(good, key, ["ordinal"]).select(*MENTION)


def _rivals(texts: Column, own: Column, by_name: bool) -> Column:
    """Names of competitors in an array of stripped texts, each once, in order. Rules of a mention look at its text, or at its name."""

    def judged(text: Column, low: Column, name: Column) -> Column:
        name_low = F.lower(name)
        said, said_low = (name, name_low) if by_name else (text, low)
        long = (F.length(said) >= 2) & ~said_low.isin(V.GENERIC_NAMES)
        return F.when(long & ~_same(said_low, own) & ~let(name_low, lambda x: _blacklisted(x) | _generic(x)), name)

    # A name is squeezed, as the text it is made of is.
    named = lambda text: let(_low(text), lambda low: let(_name(low, text), lambda name: judged(text, low, name)))
    return F.array_distinct(F.filter(F.transform(texts, named), lambda n: n.isNotNull()))


def response_mentions(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions, as :func:`mentions` gives them, from responses that hold entities and triplets.

    A chunk with one response has all its names in a row, where they are made distinct; the row meets its chunk, and only then names become
    rows. Chunks with several responses go by :func:`mentions`.
    """
    one, more = _split(responses)
    cut = items.rivals(one.select("chunk_id", "doc_id", "company", "fiscal_year", "page_start", "page_end", "response"))
    # From a Generate, so that it is computed once a row.
    owned = cut.withColumn("own", F.explode(F.array(source_company(F.col("company")))))
    named = owned.select(
        "chunk_id",
        F.col("doc_id").alias("source_doc_id"),
        F.col("own").alias("source_company"),
        F.col("fiscal_year").cast("int").alias("year"),
        F.struct("page_start", "page_end").alias("__pages"),
        F.explode(F.array(F.struct(_rivals(F.col("found.text"), F.col("own"), False).alias("entity"), _rivals(F.col("related.b"), F.col("own"), True).alias("triplet")))).alias("__names"),
    ).where((F.size("__names.entity") > 0) | (F.size("__names.triplet") > 0))
    signal = has_signal(F.coalesce("chunk_text", F.lit("")))
    signals = keep_first(chunks.select("chunk_id", "page_start", "page_end", signal.alias("__signal")), ["chunk_id"], ["page_start", "page_end", "__signal"])
    inside = F.struct(F.coalesce("__signal", F.lit(False)).alias("signal"), F.col("page_start"), F.col("page_end"), F.lit(False).alias("named"), F.lit("entity").alias("source"), F.col("__names.entity").alias("names"))
    related = F.struct(F.lit(True).alias("signal"), F.col("__pages.page_start"), F.col("__pages.page_end"), F.lit(True).alias("named"), F.lit("triplet").alias("source"), F.col("__names.triplet").alias("names"))
    both = named.join(signals, "chunk_id", "left").select("chunk_id", "source_doc_id", "source_company", "year", F.explode(F.array(inside, related)).alias("side"))
    out = both.select("*", F.explode("side.names").alias("competitor_name")).withColumns(
        {
            "page_start": F.col("side.page_start"),
            "page_end": F.col("side.page_end"),
            "has_competition_risk_signal": F.col("side.signal"),
            "explicit_competes_with": F.col("side.named"),
            "mention_source": F.col("side.source"),
        }
    ).select(*MENTION)
    return out if more is None else out.unionByName(mentions(entities(more), triplets(more), chunks))


def with_evidence(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds the chunk's text and its preview; the preview is made before the join, so a caller that reads only it moves no texts."""
    text = F.coalesce("chunk_text", F.lit(""))
    out = found.join(chunks.select("chunk_id", text.alias("chunk_text"), preview(text).alias("chunk_text_preview")), "chunk_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("chunk_text", "chunk_text_preview")})


def competitor_summary(found: DataFrame) -> DataFrame:
    key = ["source_company", "year", "competitor_name"]
    return found.dropna(subset=key).groupBy(*key).agg(
        F.count("chunk_id").alias("mention_count"),
        F.sum(F.col("has_competition_risk_signal").cast("long")).alias("competition_risk_mentions"),
        F.sum(F.col("explicit_competes_with").cast("long")).alias("explicit_competes_with_count"),
        F.min("page_start").alias("first_page_seen"),
        F.max("page_end").alias("last_page_seen"),
    )


def clean_summary(summary: DataFrame) -> DataFrame:
    """Competitors named outright, or in a competition or risk context and more than once."""
    return summary.where("explicit_competes_with_count > 0 OR (competition_risk_mentions >= 1 AND mention_count >= 2)")


def new_by_year(summary: DataFrame, company: str = "source_company", year: str = "year", name: str = "competitor_name") -> DataFrame:
    """Each competitor in its first year for a company."""
    return summary.groupBy(company, name).agg(F.min(year).alias(year)).select(company, year, F.col(name).alias("new_competitor_name"))


def top_counts(df: DataFrame, key: list[str], year: str, n: int) -> DataFrame:
    """The most frequent keys with their first and last year; ties by key."""
    counts = df.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("mentions"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return counts.orderBy(F.desc("mentions"), *key).limit(n)


def leaders(summary: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    from .incremental import keep_first as first

    return first(summary, by, order)


def yearly_pivot(df: DataFrame, year: str, company: str, name: str, companies: list[str]) -> DataFrame:
    """Distinct names by year (rows) and company (columns), 0 where there are none."""
    return df.groupBy(year).pivot(company, companies).agg(F.countDistinct(name)).na.fill(0, companies)


def interest(text: Column, kind: str = "entity") -> Column:
    """How many hints of the kind occur in a chunk."""
    hints = V.ENTITY_HINTS if kind == "entity" else V.TRIPLET_HINTS
    return hits(F.lower(F.coalesce(text, F.lit(""))), [rf"\b{h}\b" for h in hints], needed(hints))


def candidates(chunks: DataFrame, mode: str = "all", kind: str = "entity", least: int = 1, most: int | None = None) -> DataFrame:
    """Chunks to extract from: all, with a hint, or with ``least`` hints; in document order, the first ``most``."""
    score = interest(F.col("chunk_text"), kind)
    if mode not in ("all", "heuristic", "scored"):
        raise ValueError("mode must be all, heuristic or scored")
    out = chunks if mode == "all" else chunks.where(score >= (1 if mode == "heuristic" else least))
    return out if most is None else out.orderBy("company", "fiscal_year", "page_start", "page_end", "chunk_id").limit(most)


def with_context(found: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("chunk_text", "page_start")) -> DataFrame:
    """Entities with the text and first page of their chunk, or other columns of it; null where there is no such chunk.

    What is made of a text should be a column of ``chunks``: a text after the join is moved, and computed on, once for each entity.
    """
    return found.drop("page_start", "page_end").join(chunks.select("chunk_id", *columns), "chunk_id", "left")


@dataclass
class Knowledge:
    """Eight lazy tables of one corpus."""

    entities: DataFrame
    triplets: DataFrame
    facts: DataFrame
    mentions: DataFrame
    summary: DataFrame
    clean: DataFrame
    new: DataFrame
    clean_new: DataFrame


def knowledge(found: DataFrame, related: DataFrame, chunks: DataFrame) -> Knowledge:
    seen = mentions(found, related, chunks)
    summary = competitor_summary(seen)
    strong = clean_summary(summary)
    return Knowledge(
        found, related, chunk_facts(found, related), with_evidence(seen, chunks), summary, strong, new_by_year(summary), new_by_year(strong)
    )
