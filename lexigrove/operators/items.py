"""Valid, distinct items of model answers, a slice of chunks at a time as columns.

An answer's arrays come parsed from Spark and are taken apart into columns of values. A rule looks at a distinct value of a slice once; items are
numbers then, checked and made distinct in numpy, for all rows of the slice together. Array functions of SQL are interpreted, dozens of calls
for each item. Nothing is shuffled, and what is held is bounded by a slice's rows. ASCII texts stay in Arrow; others are Python strings, once each.
The rules are those of :mod:`.knowledge`, which says what an item is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: Rows that are taken apart at once.
ROWS = 256
KINDS, RELATIONS = sorted(set(V.ENTITY_TYPES.values())), list(V.RELATIONS)
ENTITIES = "array<struct<entity_text: string, entity_type: string, confidence: string>>"
TRIPLETS = "array<struct<entity_a: string, relation: string, entity_b: string>>"
FOUND = "found array<struct<text: string, low: string, kind: string, confidence: string, ordinal: int>>"
RELATED = "related array<struct<a: string, low_a: string, name: string, b: string, low_b: string, ordinal: int>>"
LISTS = ["knowledge_entities", "knowledge_entity_types", "knowledge_triplets", "knowledge_relations", "knowledge_competitors"]

_BLANK = r" \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# As in functions.text: a last line end isn't looked past, and of all line ends only U+0085 is no blank.
_ASCII_BLANK = " \t\n\x0b\f\r"
# As in functions.text: a last line end isn't looked past, and of all line ends only U+0085 is no blank.
_ENDS = re.compile(rf"\A[{_BLANK}]+|[{_BLANK}]+(?=\u0085?\Z)")
_WORDS = re.compile(rf"[^{_BLANK}]+")


def _any_of(patterns: list[str]) -> str:
    """One pattern; digits and blanks are ASCII ones, as in Spark. Word edges are of all letters and digits."""
    return "|".join(f"(?:{p})" for p in (p.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]") for p in patterns))


_METRIC, _NOT_LEADER = _any_of(V.METRIC_SIGNALS), _any_of(V.NOT_LEADER_PATTERNS)
_metric, _not_leader = re.compile(_METRIC).search, re.compile(_NOT_LEADER).search
_WORD = r"[^ \t\n\x0b\f\r]"
_PERSON = rf"\A[A-Z]{_WORD}*([ \t\n\x0b\f\r]+[A-Z]{_WORD}*){{1,4}}\z"
_NOT = {"product": V.NOT_PRODUCTS, "financial_metric": V.NOT_METRICS, "executive": V.NOT_EXECUTIVES}


def _person(text: str) -> bool:
    words = _WORDS.findall(text)
    return 2 <= len(words) <= 5 and all(unicodedata.category(w[0]) == "Lu" for w in words)


#: What the end of a relation must be, as (in Arrow for ASCII, in Python for other texts) of a text stripped and in lower case.
_ENDS_OF = {
    "OFFERS": (
        lambda text, low: pc.and_(_none_of(low, V.NOT_OFFERS), pc.less_equal(pc.count_substring_regex(text, rf"{_WORD}+"), 8)),
        lambda text, low: low not in V.NOT_OFFERS and len(_WORDS.findall(text)) <= 8,
    ),
    "LEADS_BY": (
        lambda text, low: pc.and_(pc.and_not(_none_of(low, V.NOT_LEADERS), pc.match_substring_regex(low, _NOT_LEADER)), pc.match_substring_regex(text, _PERSON)),
        lambda text, low: low not in V.NOT_LEADERS and not _not_leader(low) and _person(text),
    ),
    "REPORTS": (lambda text, low: pc.match_substring_regex(low, _METRIC), lambda text, low: bool(_metric(low))),
}


def _none_of(values: pa.Array, words: list[str]) -> pa.Array:
    return pc.invert(pc.is_in(values, value_set=pa.array(words, pa.string())))


def _flags(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(bool)


class _Texts:
    """A column of texts, null as an empty one: the number of each, and of the distinct ones, stripped, the text and its lower case."""

    def __init__(self, values: pa.Array):
        coded = values.fill_null("").dictionary_encode()
        self.code, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.odd = ~_flags(pc.string_is_ascii(distinct))
        self.text = pc.ascii_trim(distinct, characters=_ASCII_BLANK)
        if self.odd.any():
            mine = [_ENDS.sub("", v) for v in distinct.filter(pa.array(self.odd)).to_pylist()]
            self.text = pc.replace_with_mask(self.text, pa.array(self.odd), pa.array(mine, pa.string()))
        self.low = pc.ascii_lower(self.text)
        if self.odd.any():
            self.low = pc.replace_with_mask(self.low, pa.array(self.odd), pa.array([v.lower() for v in mine], pa.string()))

    def __len__(self) -> int:
        return len(self.text)

    def check(self, rule: Callable, odd_rule: Callable, at: np.ndarray) -> np.ndarray:
        """Whether the texts numbered ``at`` keep a rule, which is asked once for each that occurs."""
        used = np.unique(self.code[at])
        text, low = (c.take(pa.array(used)) for c in (self.text, self.low))
        good, odd = np.zeros(len(self), bool), self.odd[used]
        good[used] = _flags(rule(text, low))
        if odd.any():
            good[used[odd]] = [odd_rule(*both) for both in zip(*(c.filter(pa.array(odd)).to_pylist() for c in (text, low)))]
        return good[self.code[at]]

    def ends(self) -> np.ndarray:
        """Whether a text may be an end of a relation."""
        long = _flags(pc.greater_equal(pc.utf8_length(self.text), 2))
        return (long & _flags(_none_of(self.low, V.GENERIC_ENDS)))[self.code]


def _named(values: pa.Array, number: Callable[[str], int]) -> np.ndarray:
    """The number of each value, which has few distinct ones."""
    coded = values.fill_null("").dictionary_encode()
    made = [number(_ENDS.sub("", v)) for v in coded.dictionary.to_pylist()]
    return np.array(made, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]


def _kind(value: str) -> int:
    kind = V.ENTITY_TYPES.get(value.lower())
    return -1 if kind is None else KINDS.index(kind)


def _relation(value: str) -> int:
    name = value.upper()
    name = V.RELATION_ALIASES.get(name, name)
    return RELATIONS.index(name) if name in RELATIONS else -1


def _once(*parts: np.ndarray) -> np.ndarray:
    """Places of the first of equal items, whose parts are numbers from 0, in order."""
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = key * (int(p.max(initial=0)) + 1) + p
    return np.flatnonzero(~pd.Series(key).duplicated().to_numpy())


class _Side:
    """The items of one array column: the row and the place in it of each."""

    def __init__(self, items: pa.ListArray):
        self.n = len(items)
        sizes = pc.list_value_length(items).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.columns = items.flatten().flatten()
        self.row = np.repeat(np.arange(self.n), sizes)
        self.ordinal = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def lists(self, at: np.ndarray, values: pa.Array) -> pa.ListArray:
        """Values, one for each of the items ``at``, as a list a row."""
        edges = np.searchsorted(self.row[at], np.arange(self.n + 1))
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values)


class _Found(_Side):
    """Valid entities, the first of each kind and text in its row."""

    def __init__(self, items: pa.ListArray):
        super().__init__(items)
        text, kind, self.confidence = self.columns
        self.kind, said = _named(kind, _kind), _Texts(text)
        self.text, self.texts = said.code, said.text
        lows = said.low.dictionary_encode()
        self.lows, self.low = lows.dictionary, lows.indices.to_numpy(zero_copy_only=False)[self.text]
        long, good = _flags(pc.greater(pc.utf8_length(said.low), 1))[self.text], np.zeros(len(self.row), bool)
        for i, name in enumerate(KINDS):
            fits = _flags(_none_of(said.low, _NOT.get(name, [])))[self.text]
            good |= (self.kind == i) & long & fits
        valid = np.flatnonzero(good)
        self.at = valid[_once(self.row[valid], self.kind[valid], self.low[valid])]

    def items(self, kinds: list[str] | None = None) -> pa.ListArray:
        at = self.at if kinds is None else self.at[np.isin(self.kind[self.at], [KINDS.index(k) for k in kinds])]
        parts = {
            "text": self.texts.take(pa.array(self.text[at])),
            "low": self.lows.take(pa.array(self.low[at])),
            "kind": pa.array(KINDS).take(pa.array(self.kind[at])),
            "confidence": self.confidence.take(pa.array(at)),
            "ordinal": pa.array(self.ordinal[at].astype(np.int32)),
        }
        return self.lists(at, pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))

    def names(self) -> pa.ListArray:
        at = self.at[_once(self.row[self.at], self.low[self.at])]
        return self.lists(at, self.texts.take(pa.array(self.text[at])))

    def kinds(self) -> pa.ListArray:
        at = self.at[_once(self.row[self.at], self.kind[self.at])]
        return self.lists(at, pa.array(KINDS).take(pa.array(self.kind[at])))


class _Related(_Side):
    """Valid relations, the first of each pair of ends and name in its row."""

    def __init__(self, items: pa.ListArray):
        super().__init__(items)
        a, name, b = self.columns
        self.name, one, two = _named(name, _relation), _Texts(a), _Texts(b)
        self.a, self.b, self.starts, self.ends = one.code, two.code, one.text, two.text
        lows = pa.concat_arrays([one.low, two.low]).dictionary_encode()
        low = lows.indices.to_numpy(zero_copy_only=False)
        self.lows, self.low_a, self.low_b = lows.dictionary, low[: len(one)][self.a], low[len(one) :][self.b]
        good = (self.name >= 0) & one.ends() & two.ends() & (self.low_a != self.low_b)
        for relation, rules in _ENDS_OF.items():
            mine = np.flatnonzero(good & (self.name == RELATIONS.index(relation)))
            good[mine] = two.check(*rules, mine)
        valid = np.flatnonzero(good)
        self.at = valid[_once(self.row[valid], self.name[valid], self.low_a[valid], self.low_b[valid])]

    def items(self, names: list[str] | None = None) -> pa.ListArray:
        at = self.at if names is None else self.at[np.isin(self.name[self.at], [RELATIONS.index(n) for n in names])]
        parts = {
            "a": self.starts.take(pa.array(self.a[at])),
            "low_a": self.lows.take(pa.array(self.low_a[at])),
            "name": pa.array(RELATIONS).take(pa.array(self.name[at])),
            "b": self.ends.take(pa.array(self.b[at])),
            "low_b": self.lows.take(pa.array(self.low_b[at])),
            "ordinal": pa.array(self.ordinal[at].astype(np.int32)),
        }
        return self.lists(at, pa.StructArray.from_arrays(list(parts.values()), names=list(parts)))

    def labels(self) -> pa.ListArray:
        at, said = self.at, [f" [{n}] " for n in RELATIONS]

        def joined(at: np.ndarray) -> pa.Array:
            ends = self.starts.take(pa.array(self.a[at])), pa.array(said).take(pa.array(self.name[at])), self.ends.take(pa.array(self.b[at]))
            return pc.binary_join_element_wise(*ends, "")

        labels = joined(at)
        # Different relations have different labels, unless an end holds a bracket itself.
        if pc.any(pc.match_substring(self.lows, "[")).as_py():
            low = pa.array([v.lower() for v in labels.to_pylist()], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            keep = _once(self.row[at], low)
            at, labels = at[keep], labels.take(pa.array(keep))
        return self.lists(at, labels)

    def names(self) -> pa.ListArray:
        at = self.at[_once(self.row[self.at], self.name[self.at])]
        return self.lists(at, pa.array(RELATIONS).take(pa.array(self.name[at])))

    def rivals(self) -> pa.ListArray:
        at = self.at[self.name[self.at] == RELATIONS.index("COMPETES_WITH")]
        at = at[_once(self.row[at], self.low_b[at])]
        return self.lists(at, self.ends.take(pa.array(self.b[at])))


def _over(answers: DataFrame, sides: dict[str, str], make: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """The rows without their response, and what ``make`` gives of the sides, which are cut from the response by their type."""
    keep = [c for c in answers.columns if c != "response"]
    parsed = {s: F.from_json("response", f"{s} {kind}")[s].alias(f"__{s}") for s, kind in sides.items()}
    rows = answers.select(*keep, *parsed.values())
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in answers.schema if f.name != "response")
    of = {"entities": _Found, "triplets": _Related}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                held = [of[s](part.column(len(keep) + i)) for i, s in enumerate(sides)]
                made = make(*held)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=[*keep, *names])

    names = [part.split(" ", 1)[0] for part in schema.split("; ")]
    return rows.mapInArrow(run, kinds + schema.replace("; ", ", "))


def found(answers: DataFrame) -> DataFrame:
    """Rows with their valid entities in order, in place of the response."""
    return _over(answers, {"entities": ENTITIES}, lambda one: [one.items()], FOUND)


def related(answers: DataFrame) -> DataFrame:
    """Rows with their valid relations in order, in place of the response."""
    return _over(answers, {"triplets": TRIPLETS}, lambda two: [two.items()], RELATED)


def rivals(answers: DataFrame) -> DataFrame:
    """Rows with their companies and what is said to compete, in place of the response."""
    return _over(answers, {"entities": ENTITIES, "triplets": TRIPLETS}, lambda one, two: [one.items(["company"]), two.items(["COMPETES_WITH"])], f"{FOUND}; {RELATED}")


def lists(answers: DataFrame) -> DataFrame:
    """Rows with the lists of what is known of a chunk, in place of the response: texts in order, once whatever their case."""
    make = lambda one, two: [one.names(), one.kinds(), two.labels(), two.names(), two.rivals()]
    return _over(answers, {"entities": ENTITIES, "triplets": TRIPLETS}, make, "; ".join(f"{c} array<string>" for c in LISTS))
