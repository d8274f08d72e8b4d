"""Text expressions. All are Catalyst columns; none starts a Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_TERM = r"[A-Za-z][A-Za-z0-9'\-]*"
_CHUNK_TOKEN = r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*|[^\p{L}\p{N}_\s\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column used several times in an expression is text that is copied, and inside conditions and lambdas Spark
    computes each copy; a lambda's variable is a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.regexp_replace(text, _EDGE, "")


def cleaned(text: Column) -> Column:
    """Optional text: null and the word nan become empty."""
    stripped = strip(F.coalesce(text.cast("string"), F.lit("")))
    return F.regexp_replace(stripped, "(?i)^nan$", "")


def optional_text(text: Column) -> Column:
    """Optional text: blanks become null."""
    return F.nullif(cleaned(text), F.lit(""))


def optional_int(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("double").try_cast("int")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", " ")


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\s\p{Z}]+")).cast("int")


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found, as one alternation."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def hits(text: Column, patterns: Iterable[str], parts: Iterable[str] | None = None) -> Column:
    """How many of the patterns are found. ``parts``: a plain text that each needs; it is looked for first, which costs far less."""
    patterns = list(patterns)
    needed = [None] * len(patterns) if parts is None else list(parts)

    def count(x: Column) -> Column:
        total = F.lit(0)
        for p, part in zip(patterns, needed, strict=True):
            found = x.rlike(p) if part is None else x.contains(part) & x.rlike(p)
            total = total + found.cast("int")
        return total

    return let(text, count)


def needed(patterns: Iterable[str]) -> list[str | None]:
    """The plain text that a pattern of words needs, for :func:`hits`, where it is that simple: words between edges, maybe with an optional last letter."""
    parts = [re.sub(r".[?]$", "", p.removeprefix(r"\b").removesuffix(r"\b")) for p in patterns]
    return [p if re.fullmatch("[a-z ]+", p) else None for p in parts]


def slug(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\p{L}\p{N}]+", ""))


def doc_name(text: Column) -> Column:
    """Lower case, runs of anything else become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def path_safe(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(text), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(out == "", "item").otherwise(out)


def year_hint(name: Column) -> Column:
    """The first year in a file name, else 0."""
    return F.coalesce(F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int"), F.lit(0))


def title_case(text: Column) -> Column:
    """Upper case after anything but a letter, lower case otherwise. Plain words, with marks only at their ends, need no look at each letter."""
    plain = r"^(?:[a-z]+[.,;:!?)]*(?: |\z))*\z"

    def cased(low: Column) -> Column:
        first = lambda i: (i == 0) | ~low.substr(i, F.lit(1)).rlike(r"\p{L}")
        return F.array_join(F.transform(F.split(low, ""), lambda c, i: F.when(first(i), F.upper(c)).otherwise(c)), "")

    return let(F.lower(text), lambda low: F.when(low.rlike(plain), F.initcap(low)).otherwise(cased(low)))


def preview(text: Column, size: int = 280) -> Column:
    head = F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))
    return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(head)


def content_hash(text: Column) -> Column:
    return F.sha2(strip(F.coalesce(text, F.lit(""))).cast("binary"), 256)


# Terms of lexical retrieval --------------------------------------------------------------------------------


def stem(token: Column) -> Column:
    """Lower case without possessive; then, over four letters long, without plural.

    Only a token that ends in s goes through the chain of replacements.
    """
    low = F.replace(F.lower(token), F.lit("’"), F.lit("'"))
    bare = F.regexp_replace(low, "'s$", "")
    short = F.regexp_replace(F.regexp_replace(bare, "^(.{2,})ies$", "$1y"), "^(.{3,}[^s])s$", "$1")
    return F.when(low.endswith("s"), short).otherwise(low)


def _kept(term: Column, drop_stopwords: bool) -> Column:
    keep = (F.length(term) >= 3) | term.isin(V.SHORT_TOKENS)
    if drop_stopwords:
        keep = keep & (~term.isin(V.STOPWORDS) | term.isin(V.SHORT_TOKENS))
    return keep


def terms(text: Column, drop_stopwords: bool = False) -> Column:
    """Stemmed terms in order, repeats included."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TERM), F.lit(0))
    return F.filter(F.transform(raw, stem), lambda t: _kept(t, drop_stopwords))


def coverage(query_terms: Column, text_terms: Column) -> Column:
    """Share of the distinct query terms found in the text; 0 without query terms."""
    share = lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_intersect(w, text_terms)) / F.size(w))
    return let(F.array_distinct(query_terms), share)


# Tokens of chunks ------------------------------------------------------------------------------------------


def chunk_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CHUNK_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_CHUNK_TOKEN)).cast("int")


def untokenize(tokens: Column) -> Column:
    """Tokens as text: no blank before closing marks nor after opening ones.

    Tokens hold no blanks, so joining them and removing blanks at the marks is the same, in one pass each.
    """
    return tightened(F.array_join(tokens, " "))


def tightened(joined: Column) -> Column:
    """:func:`untokenize` of tokens that are joined by blanks already."""
    text = F.regexp_replace(joined, r" ([.,;:!?%)\]}])", "$1")
    return strip(F.regexp_replace(text, r"([(\[{$]) ", "$1"))


def sentences(text: Column) -> Column:
    """Parts between full stops followed by a blank, stripped, blank ones left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\. "), strip)
    return F.filter(parts, lambda s: s != "")
