"""How often the terms of a query stand in a text, for pairs of query and text.

A text is cut into terms once, in the row that holds it, and only counts of the query's own terms leave the row: the terms of a text are never
rows of a shuffle. The rules are those of :func:`functions.text.terms`; terms are ASCII, so bytes that aren't UTF-8 decide nothing. A task
holds ``ROWS`` rows and a bounded memo of stems.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import _TERM

#: Rows in memory at once, and tokens whose stems a worker remembers.
ROWS, MEMO = 256, 200_000
COUNTS = "dl int, covered int, hits array<struct<at: int, tf: int>>"


class Stems(dict):
    """Term of a token, or None where terms leave it out."""

    short = frozenset(V.SHORT_TOKENS)

    def __missing__(self, token: str) -> str | None:
        term = token.lower()
        if term.endswith("s"):
            term = term.removesuffix("'s")
            term = re.sub("^(.{2,})ies$", r"\1y", term)
            term = re.sub("^(.{3,}[^s])s$", r"\1", term)
        if len(self) >= MEMO:
            self.clear()
        self[token] = term = term if len(term) >= 3 or term in self.short else None
        return term


def posted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): the terms of each text, stopwords left out, and how often they stand in it. A row is counted by itself, so keys should be
    distinct; nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()
    left_out = frozenset(V.STOPWORDS) - Stems.short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stems = re.compile(_TERM).findall, Stems()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                sizes, words, tf = [], [], []
                for raw in part.column(1).to_pylist():
                    # Different words may have one term.
                    own: dict[str, int] = {}
                    for word, n in Counter(find((raw or b"").decode("latin-1"))).items():
                        term = stems[word]
                        if term is not None:
                            own[term] = own.get(term, 0) + n
                    for term in left_out.intersection(own):
                        del own[term]
                    sizes.append(len(own))
                    words.extend(own)
                    tf.extend(own.values())
                keys = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), sizes)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(words, pa.string()), pa.array(tf, pa.int64())], names=[key, "term", "tf"])

    return rows.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {kind}, term string, tf long")


def counted(rows: DataFrame, wanted: str, text: str, title: str | None = None) -> DataFrame:
    """Adds dl (terms of title and text), covered (how many wanted terms are in the text) and hits: the places ``at`` (from 0) in
    ``wanted``, an array of distinct terms, and counts ``tf`` of those in title or text. Nulls have no terms."""
    out = rows.withColumns({"__text": F.col(text).cast("binary"), "__title": (F.lit(None) if title is None else F.col(title)).cast("binary")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    keep = rows.columns
    names = [*keep, "dl", "covered", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stems = re.compile(_TERM).findall, Stems()

        def cut(raw: bytes | None) -> list[str]:
            return [t for t in map(stems.__getitem__, find((raw or b"").decode("latin-1"))) if t is not None]

        before, own, whole, dl = None, None, None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lengths, covered, sizes, at, tf = [], [], [], [], []
                for words, *texts in zip(*(part.column(c).to_pylist() for c in (wanted, "__text", "__title"))):
                    if texts != before:
                        before, own, head = texts, Counter(cut(texts[0])), cut(texts[1])
                        whole, dl = (own + Counter(head) if head else own), own.total() + len(head)
                    words = words or []
                    mine = [i for i, w in enumerate(words) if w in whole]
                    lengths.append(dl)
                    covered.append(len(mine) if whole is own else sum(w in own for w in words))
                    sizes.append(len(mine))
                    at += mine
                    tf += [whole[words[i]] for i in mine]
                pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(tf, pa.int32())], names=["at", "tf"])
                hits = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pairs)
                kept = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lengths, pa.int32()), pa.array(covered, pa.int32()), hits], names=names)

    return out.mapInArrow(run, f"{kinds}, {COUNTS}")
