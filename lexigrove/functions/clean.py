"""Page cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import any_of, strip


def characters(text: Column) -> Column:
    """Odd blanks, quotes, dashes, bullets and ellipses as plain ones; line ends as line feeds."""
    one = V.BLANKS + V.DOUBLE_QUOTES + V.SINGLE_QUOTES + V.DASHES
    to = " " * len(V.BLANKS) + '"' * len(V.DOUBLE_QUOTES) + "'" * len(V.SINGLE_QUOTES) + "-" * len(V.DASHES)
    out = F.translate(F.coalesce(text, F.lit("")), one + V.DELETED, to)
    out = F.regexp_replace(out, f"[{V.ELLIPSES}]", "...")
    return F.regexp_replace(out, r"\r\n?", "\n")


def line(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"[ \t]+", " ")


def is_noise(text: Column, aggressive: bool = False) -> Column:
    patterns = V.PAGE_NOISE + (V.PAGE_NOISE_AGGRESSIVE if aggressive else [])
    return text.isin(V.PAGE_NOISE_EXACT) | any_of(text, patterns)


def page(text: Column, aggressive: bool = False) -> Column:
    """A page without navigation, page numbers and rules; blank lines go, as they count as noise."""
    lines = F.transform(F.split(characters(text), "\n"), line)
    kept = F.filter(lines, lambda x: ~is_noise(x, aggressive))
    out = strip(F.array_join(kept, "\n"))
    if aggressive:
        letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
        dense = F.filter(F.split(out, "\n"), lambda x: (x != "") & (letters(x) / F.greatest(F.lit(1), F.length(x)) >= 0.3))
        out = strip(F.array_join(dense, "\n"))
    return out
