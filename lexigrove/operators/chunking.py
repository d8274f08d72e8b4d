"""Pages to chunks: cleaning, sections, fixed-size and sentence chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, sections
from ..functions.text import chunk_tokens, let, sentences, tightened, token_count, word_count, words
from ..sources.scratch import saved
from .checks import require

NEARLY_EMPTY = 20


def process_pages(pages: DataFrame, aggressive: bool = False) -> DataFrame:
    """Adds clean_text, character and word counts of both texts, and whether hardly a word is left."""
    out = require(pages, ["raw_text"]).withColumn("clean_text", clean.page(F.col("raw_text"), aggressive))
    raw = F.coalesce("raw_text", F.lit(""))
    return out.withColumns(
        {
            "raw_char_count": F.length(raw),
            "raw_word_count": word_count(raw),
            "clean_char_count": F.length("clean_text"),
            "clean_word_count": word_count(F.col("clean_text")),
        }
    ).withColumn("is_nearly_empty", F.col("clean_word_count") < NEARLY_EMPTY)


def annotate(pages: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Adds section_id, section_code, section_title, section_group, carried forward over a document's pages."""
    return _carried(pages.withColumn("__found", sections.page_section(F.col(text_col))), pages.columns)


def _carried(found: DataFrame, keep: list[str]) -> DataFrame:
    """Sections from what was found on each page; texts needn't be among the columns kept."""
    code, title, group = (F.lit(x) for x in ("front_matter", "Front Matter", "front_matter"))
    by_page = Window.partitionBy("doc_id").orderBy("page_num")
    so_far = F.last("__found", ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("__now", so_far)
    before = F.coalesce(F.lag(F.col("__now.code")).over(by_page), code)
    found = found.withColumn("__enter", (F.col("__now").isNotNull() & (F.col("__now.code") != before)).cast("int"))
    nth = F.sum("__enter").over(
        Window.partitionBy("doc_id", "__now.code").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    )
    found = found.withColumn("__nth", nth)
    known = F.col("__now").isNotNull()
    return found.select(
        *keep,
        F.when(known, F.format_string("%s__%02d", "__now.code", "__nth")).otherwise("front_matter__01").alias("section_id"),
        F.coalesce("__now.code", code).alias("section_code"),
        F.coalesce("__now.title", title).alias("section_title"),
        F.coalesce("__now.grp", group).alias("section_group"),
    )


def window_starts(n: Column, size: int, overlap: int, least: int) -> Column:
    """Starts of windows of ``size`` units over ``n``; a short rest becomes a window that ends with the text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    regular = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(n - 1, n - least)), F.lit(step))
    last = F.element_at(regular, -1)
    tail = (last + step < n) & (n - size > last)
    starts = F.when(tail, F.concat(regular, F.array(n - size))).otherwise(regular)
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(starts)


def fixed_chunks(pages: DataFrame, method: str = "token", size: int = 500, overlap: int = 75, least: int = 100) -> DataFrame:
    """Windows over the tokens or words of each run of pages in one section.

    A running sum over a section's pages, without their texts, numbers its units, and each page says by arithmetic which windows it has a part of;
    the parts of a window meet by its key. So a task holds a page or a window (``size`` units), never a section or a document; a chunk's place in
    its document follows from the numbers of windows of the sections before it.
    """
    if method not in ("token", "word"):
        raise ValueError("method must be token or word")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    require(pages, ["doc_id", "company", "fiscal_year", "page_num", "clean_text"])
    units = (chunk_tokens if method == "token" else words)(F.col("clean_text"))
    shared = [c for c in ("company", "fiscal_year", "document_type", "file_name") if c in pages.columns]
    own = [*shared, "section_code", "section_title", "section_group"]
    # Units hold no blanks: joined by them they are a text again, several times smaller than an array. Pages are cut once and written.
    cut = pages.where("doc_id IS NOT NULL").select(
        "doc_id", "page_num", *shared, F.monotonically_increasing_id().alias("id"), sections.page_section(F.col("clean_text")).alias("__found"),
        let(units, lambda x: F.struct(F.array_join(x, " ").alias("units"), F.size(x).alias("n"))).alias("u"),
    )
    cut = saved(cut.select("*", "u.units", "u.n").drop("u"), "units")
    marked = _carried(cut.drop("units"), ["doc_id", "page_num", *shared, "id", "n"])
    in_order = Window.partitionBy("doc_id", "section_id").orderBy("page_num", "id")
    marked = marked.withColumn("at", (F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).cast("int"))
    sections_ = marked.groupBy("doc_id", "section_id").agg(
        F.sum("n").cast("int").alias("total"), F.min("page_num").alias("first_page"), F.min_by(F.struct(*own), F.struct("page_num", "id")).alias("own")
    )
    # Regular windows start at multiples of the step; a short rest becomes one that ends with the section.
    step, total = size - overlap, F.col("total")
    regular = F.when(total <= size, 1).otherwise(F.floor(F.greatest(F.lit(0), F.least(total - 1, total - least)) / step).cast("int") + 1)
    last = (F.col("regular") - 1) * step
    tail = (total > size) & (last + step < total) & (total - size > last)
    counted = sections_.where("total > 0").withColumn("regular", regular).withColumn("tail", tail)
    before = Window.partitionBy("doc_id").orderBy("first_page", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum(F.col("regular") + F.col("tail").cast("int")).over(before), F.lit(0)).cast("int"))
    parts = marked.where("n > 0").select("doc_id", "page_num", "section_id", "id", "n", "at").join(counted, ["doc_id", "section_id"])
    # Windows k that overlap units at .. at + n - 1.
    low = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / F.lit(step)).cast("int"))
    high = F.least(F.col("regular") - 1, F.floor((F.col("at") + F.col("n") - 1) / F.lit(step)).cast("int"))
    hit = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), (k * step).alias("start")))).otherwise(F.array().cast("array<struct<k: int, start: int>>"))
    at_end = F.when(F.col("tail") & (F.col("at") + F.col("n") > total - size), F.array(F.struct(F.col("regular").alias("k"), (total - size).alias("start")))).otherwise(F.array().cast("array<struct<k: int, start: int>>"))
    placed = parts.select("doc_id", "section_id", "page_num", "id", "n", "at", "before", "own", F.concat(hit, at_end).alias("windows"))
    # A page's text meets its windows once, and then only what they take of it is sent.
    begin = lambda w: F.greatest(w["start"], F.col("at"))
    length = lambda w: F.least(w["start"] + size, F.col("at") + F.col("n")) - begin(w)
    taken = let(
        F.split("units", " "),
        lambda x: F.transform("windows", lambda w: F.struct(w["k"].alias("k"), length(w).alias("n"), F.array_join(F.slice(x, begin(w) - F.col("at") + 1, length(w)), " ").alias("units"))),
    )
    pieces = placed.join(cut.select("id", "units"), "id").select("doc_id", "section_id", "page_num", "at", "before", "own", F.explode(taken).alias("w"))
    pieces = pieces.select("doc_id", "section_id", "page_num", "at", "own", (F.col("before") + F.col("w.k")).alias("chunk_index"), F.col("w.n").alias("n"), F.col("w.units").alias("units"))
    whole = pieces.groupBy("doc_id", "section_id", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "units"))), lambda p: p["units"]), " ").alias("mine"),
        F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.sum("n").cast("int").alias("__n"), F.first("own").alias("own"),
    )
    text = tightened(F.col("mine")) if method == "token" else F.col("mine")
    whole = whole.select("doc_id", "section_id", "chunk_index", "page_start", "page_end", "__n", "own.*", text.alias("chunk_text"))
    count = F.col("__n") if method == "token" else token_count(F.col("chunk_text"))
    whole = whole.withColumns({"word_count": word_count(F.col("chunk_text")), "token_count": count, "char_count": F.length("chunk_text")})
    key = F.format_string("%s_p%04d_p%04d_c%04d", F.col("doc_id").cast("string"), "page_start", "page_end", "chunk_index")
    return whole.select(
        key.alias("chunk_id"), "chunk_index", "doc_id", *shared, "page_start", "page_end", "chunk_text", "word_count", "token_count",
        "char_count", "section_id", "section_code", "section_title", "section_group",
    )


def _pack(size: int, overlap: int, least: int, tolerance: float):
    """Walks the token counts of a section's sentences; gives each chunk's parts by page."""
    most = int(size * tolerance)

    def walk(ends: np.ndarray) -> np.ndarray:
        n, start, chunks = len(ends) - 1, 0, []
        while start < n:
            # The last sentence end within the limit; a sentence longer than that stands alone.
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
            chunks.append((start, end))
            start = max(start + 1, end - overlap) if end < n else n
        return np.array(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, rows = [], []
            for i, pages in enumerate(batch["pages"]):
                pages = sorted(pages, key=lambda p: p["at"])
                firsts = np.array([p["at"] for p in pages])
                ends = np.concatenate([[0], *[p["tokens"] for p in pages]]).cumsum()
                begin, end = walk(ends).T
                low = np.searchsorted(firsts, begin, "right") - 1
                count = np.searchsorted(firsts, end - 1, "right") - low
                k = np.repeat(np.arange(len(begin)), count)
                page = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + low[k]
                ids = np.array([p["id"] for p in pages])
                tokens = (ends[end] - ends[begin])[k]
                parts.append(np.stack([k, ids[page], firsts[page], begin[k], end[k], tokens, np.full(len(k), len(begin))]))
                rows.append(np.full(len(k), i))
            if not parts:
                continue
            out = pd.DataFrame(np.concatenate(parts, axis=1).T, columns=["k", "id", "at", "start", "stop", "tokens", "n_chunks"])
            out["short"] = (out.k == out.n_chunks - 1) & (out.k > 0) & (out.tokens < least)
            own = batch.drop(columns="pages").iloc[np.concatenate(rows)].reset_index(drop=True)
            yield pd.concat([own, out], axis=1)

    return run


def sentence_chunks(pages: DataFrame, size: int = 500, overlap: int = 1, least: int = 100, tolerance: float = 1.2) -> DataFrame:
    """Greedy packing of sentences up to ``tolerance * size`` tokens within a section; a short last chunk of a document is merged
    with the one before it in its section.

    Where a chunk ends depends on where the one before did, but only inside its section: the first sentence of a section always
    starts a chunk. So sections are walked apart from each other, over the token counts of their sentences alone (numpy). Pages are
    cut into sentences once and written; sections, running sums and the walk see no text, and a page says by arithmetic which of its
    sentences a chunk has. A task holds a page, a chunk, or one number a sentence of a section. Pages without a document id have no chunks.
    """
    require(pages, ["doc_id", "company", "fiscal_year", "page_num", "clean_text"])
    counted = F.transform(sentences(F.coalesce("clean_text", F.lit(""))), lambda x: F.struct(x.alias("sentence"), token_count(x).alias("tokens")))
    cut = pages.where("doc_id IS NOT NULL").select(
        "doc_id", "page_num", "company", "fiscal_year", F.monotonically_increasing_id().alias("id"),
        sections.page_section(F.col("clean_text")).alias("__found"), F.filter(counted, lambda x: x["tokens"] > 0).alias("parts"),
    )
    cut = saved(cut, "sentences")
    narrow = cut.select("doc_id", "page_num", "id", "__found", F.col("parts.tokens").alias("tokens"))
    marked = _carried(narrow, ["doc_id", "page_num", "id", "tokens"]).withColumn("n", F.size("tokens")).where("n > 0")
    so_far = Window.partitionBy("doc_id", "section_id").orderBy("page_num", "id").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("at", (F.sum("n").over(so_far) - F.col("n")).cast("long"))
    lengths = marked.groupBy("doc_id", "section_id").agg(
        F.first("section_code").alias("section_code"), F.min("page_num").alias("first_page"), F.collect_list(F.struct("at", "id", "tokens")).alias("pages")
    )
    kind = dict(pages.dtypes)
    schema = f"doc_id {kind['doc_id']}, section_id string, section_code string, first_page {kind['page_num']}, k long, id long, at long, start long, stop long, tokens long, n_chunks long, short boolean"
    walked = lengths.mapInPandas(_pack(size, overlap, least, tolerance), schema)
    # Chunks of the sections before, and whether a section is a document's last.
    in_doc = Window.partitionBy("doc_id").orderBy("first_page", "section_id")
    placed = walked.withColumn("upto", F.sum(F.when((F.col("k") == 0) & (F.col("at") == 0), F.col("n_chunks")).otherwise(0)).over(in_doc))
    placed = placed.withColumn("rest", F.col("short") & (F.col("upto") == F.max("upto").over(Window.partitionBy("doc_id"))))
    placed = placed.withColumn("chunk_index", (F.col("upto") - F.col("n_chunks") + F.col("k") - F.col("rest").cast("int")).cast("int"))
    joined = placed.join(cut.select("id", "page_num", "company", "fiscal_year", "parts"), "id")
    low = F.greatest(F.lit(0), F.col("start") - F.col("at")).cast("int")
    high = F.least(F.col("stop") - F.col("at"), F.size("parts")).cast("int")
    parts = joined.withColumn("mine", F.array_join(F.slice("parts.sentence", low + 1, high - low), " "))
    own = ["company", "fiscal_year", "section_code"]
    one = parts.groupBy("doc_id", "section_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("rest", "at", "mine"))).alias("pieces"),
        F.min_by(F.struct(*own), F.struct("rest", "at")).alias("own"),
        F.min("page_num").alias("page_start"),
        F.max("page_num").alias("page_end"),
        F.max(F.when(~F.col("rest"), F.col("page_num"))).alias("__end"),
        # Every part of a chunk has the chunk's count.
        (F.max(F.when(~F.col("rest"), F.col("tokens"))) + F.coalesce(F.max(F.when(F.col("rest"), F.col("tokens"))), F.lit(0))).alias("token_count"),
    )
    key = F.format_string("%s_p%04d_p%04d_c%04d", F.col("doc_id").cast("string"), "page_start", "__end", "chunk_index")
    return one.select(
        key.alias("chunk_id"), "chunk_index", "doc_id", "own.company", "own.fiscal_year", F.col("page_start").cast("int").alias("page_start"),
        F.col("page_end").cast("int").alias("page_end"), F.array_join("pieces.mine", " ").alias("chunk_text"), F.col("token_count").cast("int").alias("token_count"),
        "section_id", "own.section_code",
    )


def first_documents(pages: DataFrame, n: int) -> DataFrame:
    """Pages of the first ``n`` documents in order of their ids."""
    chosen = pages.select("doc_id").distinct().orderBy("doc_id").limit(n)
    return pages.join(chosen, "doc_id", "left_semi")


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` pages of each document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    return pages.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def chunk_documents(pages: DataFrame, method: str = "token", limit: int | None = None, **options) -> DataFrame:
    """Chunks by token, word or sentence."""
    if limit is not None:
        pages = first_documents(pages, limit)
    return sentence_chunks(pages, **options) if method == "sentence" else fixed_chunks(pages, method, **options)


def navigation(text: Column) -> Column:
    """Whether a chunk is mostly boilerplate: its first 20 lines are headings of it and it has few words."""
    from ..functions import values as V
    from ..functions.text import any_of, let, strip

    lines = lambda x: F.filter(F.transform(F.split(x, r"\R"), strip), lambda y: y != "")

    def judged(n: Column, head: Column) -> Column:
        noise = F.size(F.filter(head, lambda x: x.isin(V.CHUNK_NOISE_EXACT) | any_of(x, V.CHUNK_NOISE)))
        few = (n < 40) & (noise == F.size(head))
        return (F.size(head) == 0) | ((n < 80) & (few | (noise / F.greatest(F.lit(1), F.size(head)) >= 0.7)))

    return let(F.coalesce(text, F.lit("")), lambda x: let(word_count(x), lambda n: let(F.slice(lines(x), 1, 20), lambda h: judged(n, h))))
