"""Personal data with offset-preserving deobfuscation.

Base detectors (email, ip, card, phone) run on the text as it is. Then transducers undo disguises while
keeping, for each character they emit, the source characters it stands for:

1. characters: zero-width characters go; full-width and mathematical forms, foreign decimal digits and
   Cyrillic/Greek lookalikes become ASCII; odd dots, dashes, at-signs and blanks become plain ones;
2. signs: spelled, bracketed or spaced at-signs and dots between two labels become ``@`` and ``.`` in the whole text
   (``name [at] site (dot) org``), with any number of labels. Of the addresses found then, one with a bare ``at`` counts only with
   a well-known last label, and with a spelled dot or a name that is no plain word, so that prose isn't taken for an
   address; dots between four numbers count too;
3. runs of spelled digits (``four one one one ...``, ``plus one ...``, ``dot`` between them) become digits;
4. letters that look like digits (O, o, l, I) inside long runs of digits become digits.

The detectors run again on what the transducers emit; a hit is mapped back to source positions and added
if it overlaps no span found before, or contains it whole (``аlice@example.com`` whose first letter is Cyrillic). Base
spans always stay.

Work per text is linear: the patterns are possessive, bounded or anchored at ``@``, ``+`` or the start of a digit run,
which gives the same matches as the plain leftmost patterns, and the sorted hits are merged with the sorted base spans.

Defined cases: a null text is the empty one; positions are code points, ends exclusive; spans are ordered by
start, then kind; repeated rows get equal results; extra columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, over_rows, table, text_bytes

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Matches of local@label(.label)+, found from each at-sign: its local part is the run before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    out.sort()
    return out


#: Letters of other scripts that look like the ASCII letter beside them.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ı": "i", "ɡ": "g", "ո": "n", "օ": "o",
}
#: Marks that stand for an ASCII one, and characters without width.
MARKS = {"․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@", "\xa0": " ", " ": " ", " ": " "}
#: Escapes of the at-sign and the dot.
ESCAPES = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&#x2e;": ".", "&period;": ".", "%2e": "."}
NO_WIDTH = "​‌‍⁠﻿\xad"


@lru_cache(maxsize=1)
def _characters() -> tuple[frozenset, dict[str, str]]:
    """Characters to rewrite, and what to; wide and mathematical forms and digits follow from Unicode."""
    table = {**LOOKALIKES, **MARKS, **dict.fromkeys(NO_WIDTH, "")}
    for block in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
        for c in map(chr, block):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[c] = plain
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            table.setdefault(c, str(unicodedata.decimal(c)))
    return frozenset(table), table


_ESCAPE = re.compile("|".join(map(re.escape, ESCAPES)), re.IGNORECASE)


class Mapped:
    """A string with the source span of each of its characters."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text, self.starts, self.ends = text, starts, ends

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


def _plain_characters(text: str) -> Mapped:
    found, table = _characters()
    escaped = ("&" in text or "%" in text) and _ESCAPE.search(text)
    if not escaped and (text.isascii() or found.isdisjoint(set(text))):
        return Mapped(text)
    out, starts, ends = [], [], []
    done = 0
    for m in [*(_ESCAPE.finditer(text) if escaped else ()), None]:
        stop = m.start() if m else len(text)
        for i in range(done, stop):
            c = table.get(text[i], text[i])
            if c:
                out.append(c)
                starts.append(i)
                ends.append(i + 1)
        if m:
            out.append(ESCAPES[m[0].lower()])
            starts.append(m.start())
            ends.append(m.end())
            done = m.end()
    return Mapped("".join(out), starts, ends)


#: Last labels that a spelled address must end in.
LAST_LABELS = "com org net edu gov info biz io ai co uk us eu de fr es it nl ch at be ca au nz ie in jp cn br mx pl se no dk fi ru dev app me tv".split()
_AT_WORD, _DOT_WORD = "(?:at|arobase|arroba)", "(?:dot|punkt|punto|point)"
_IN = r"[\[({<]\s{0,3}"
_OUT = r"\s{0,3}[\])}>]"
_AT = rf"(?:\s{{1,3}}@\s{{0,3}}|@\s{{1,3}}|\s{{0,3}}{_IN}(?:@|{_AT_WORD}){_OUT}\s{{0,3}}|\s{{1,3}}-?{_AT_WORD}-?\s{{1,3}}|[-_]{_AT_WORD}[-_])"
_DOT = rf"(?:\s{{0,3}}{_IN}(?:\.|{_DOT_WORD}){_OUT}\s{{0,3}}|\s{{1,3}}-?{_DOT_WORD}-?\s{{1,3}}|[-_]{_DOT_WORD}[-_])"
#: A disguised sign has a character of a name or label on either side.
_SIGN = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:(?P<at>{_AT})|{_DOT})(?=[A-Za-z0-9_%+-])", re.IGNORECASE)
_SIGN_HINT = re.compile(rf"[\[({{<]|\s@|@\s|{_AT_WORD}|{_DOT_WORD}", re.IGNORECASE)

#: Digits in words (English, German, French, Spanish).
SPELLED = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_UNIT = rf"(?:{_WORDS}|[0-9]++)"
_GAP = rf"(?:[\s,().-]{{1,3}}(?:{_DOT_WORD}\s{{1,3}})?)"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)\s{{0,3}})?{_UNIT}(?:{_GAP}{_UNIT}){{3,}}(?!\w)", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_WORDS})[\s,().-]{{1,3}}(?:{_WORDS}|{_DOT_WORD}|[0-9])(?!\w)", re.IGNORECASE)
_SPELLED_TOKEN = re.compile(rf"(?P<plus>plus|\+)|(?P<dot>{_DOT_WORD}|\.)|(?P<word>{_WORDS})(?!\w)|(?P<digit>[0-9])|(?P<skip>[\s,()-])", re.IGNORECASE)
_LOOKALIKE_DIGITS = re.compile(r"(?<![\w+])(?:\+[0-9OolIBS][\x20().0-9OolIBS-]{8,}[0-9OolIBS]|[0-9OolIBS](?:[\x20-]?[0-9OolIBS]){9,})(?!\w)")
_LOOKALIKE_HINT = re.compile(r"[0-9][\x20-]?[OolIBS]|[OolIBS][\x20-]?[0-9]")
_TO_DIGIT = str.maketrans("OolIBS", "001185")


class _Signs:
    """A text in which every disguised sign is a plain one; between signs positions move together."""

    def __init__(self, text: str):
        self.spots = [(*m.span(), "@" if m["at"] else ".", bool(m["at"]) and m[0].strip(" \t\n\r-_").isalpha()) for m in _SIGN.finditer(text)]
        out, done, size = [], 0, 0
        self.places: list[int] = []
        for a, b, sign, _ in self.spots:
            out += [text[done:a], sign]
            size += a - done
            self.places.append(size)
            size += 1
            done = b
        self.text = "".join(out) + text[done:]

    def inside(self, start: int, end: int) -> range:
        """Numbers of the rewritten signs in a stretch."""
        return range(bisect_left(self.places, start), bisect_left(self.places, end))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """A stretch that neither starts nor ends with a rewritten sign."""
        shift = lambda at: at if (k := bisect_left(self.places, at)) == 0 else at + self.spots[k - 1][1] - self.places[k - 1] - 1
        return shift(start), shift(end - 1) + 1


def _rewritten_signs(text: str):
    """(start, kind, end) of what the detectors find once spelled, bracketed or spaced at-signs and dots are plain ones.

    Whether a bare word was meant as a sign is decided by the address that it makes: it needs a known last label, and a spelled
    dot or a name that is no plain word. Labels after a spelled dot that can't be last ones are left out from the end.
    """
    if not _SIGN_HINT.search(text):
        return
    signs = _Signs(text)
    if not signs.spots:
        return
    plain = signs.text
    for start, end in _emails(plain):
        at = plain.index("@", start)
        within = signs.inside(start, end)
        if not within:
            continue
        bare = any(signs.places[k] == at and signs.spots[k][3] for k in within)
        dots = {signs.places[k] for k in within if signs.spots[k][2] == "."}
        while True:
            dot = plain.rindex(".", at, end)
            last = plain[dot + 1 : end]
            good = len(last) >= 2 and last.isalpha() and (not bare or last.lower() in LAST_LABELS)
            if good or dot not in dots or plain.find(".", at, dot) < 0:
                break
            end = dot
        dots = {d for d in dots if d < end}
        # What is left may have no rewritten sign, and is then found without this.
        if good and (dots or any(signs.places[k] == at for k in within)) and (not bare or dots or re.search(r"[0-9._]", plain[start:at])):
            s, e = signs.source(start, end)
            yield s, 0, e
    if "." in {spot[2] for spot in signs.spots}:
        for m in _IP.finditer(plain):
            if signs.inside(*m.span()) and all(map(_small, m[0].split("."))):
                s, e = signs.source(*m.span())
                yield s, 1, e


def _rewritten_numbers(text: str):
    """(start, kind, end) of identifiers in runs of spelled digits or of letters that look like digits."""
    if sum(map(SPELLED.__contains__, _LETTERS.findall(text.lower()))) >= 3 and _SPELLED_HINT.search(text):
        for run in _SPELLED_RUN.finditer(text):
            out, at, words = [], [], 0
            for m in _SPELLED_TOKEN.finditer(text, run.start(), run.end()):
                kind = m.lastgroup
                words += kind == "word"
                if kind != "skip":
                    out.append({"plus": "+", "dot": "."}.get(kind) or (str(SPELLED[m[0].lower()]) if kind == "word" else m[0]))
                    at.append(m.span())
            if words >= 3:
                string = "".join(out)
                for s, kind, e in detect(string) + ([] if "." not in string or string.count(".") == 3 else detect(string.replace(".", ""))):
                    if kind and e <= len(at):
                        yield at[s][0], kind, at[e - 1][1]
    if _LOOKALIKE_HINT.search(text):
        for run in _LOOKALIKE_DIGITS.finditer(text):
            if len(_DIGITS.findall(run[0])) >= 8 and not run[0].isdigit():
                for s, kind, e in detect(run[0].translate(_TO_DIGIT)):
                    yield run.start() + s, kind, run.start() + e


def find(text: str) -> tuple[list, list]:
    """(base spans, added spans), each a list of (start, kind number, end) in source code points."""
    base = detect(text)
    plain = _plain_characters(text)
    hits = list(detect(plain.text)) if plain.starts is not None else []
    hits += _rewritten_signs(plain.text)
    hits += _rewritten_numbers(plain.text)
    added: list = []
    near: list = []  # spans that start before the end of a hit and may reach into it
    at = 0
    for s, kind, e in sorted(hits, key=lambda h: (h[0], h[1])):
        s, e = plain.source(s, e)
        while at < len(base) and base[at][0] < e:
            near.append((base[at][0], base[at][2]))
            at += 1
        # Hits come by start: what ends before one of them is behind all later ones.
        near = [(a, b) for a, b in near if s < b]
        touched = [(a, b) for a, b in near if a < e]
        # It may contain spans found before, if what it has besides isn't just marks that stand for ASCII ones.
        if all(s <= a and b <= e and e - s > b - a and MARKS.keys().isdisjoint(text[s:a] + text[b:e]) for a, b in touched):
            near.append((s, e))
            added.append((s, kind, e))
    return base, added


def _joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def _text(raw: bytes | None) -> str:
    return "" if raw is None else raw.decode("utf-8", "replace")


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base counts by kind, digest of the base spans, all spans, number of added ones)."""

    def run(keys, texts):
        rows = []
        for t in texts:
            base, added = find(_text(t))
            kinds = [k for _, k, _ in base]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*map(kinds.count, range(4)), digest, _joined(sorted(base + added)), len(added)))
        return keys, *(list(c) for c in (zip(*rows) if rows else [()] * 7))

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(df.select(F.col(id_col), text_bytes(text_col).alias("text")), run, f"`{id_col}` {kind}, {FIELDS}")


def blank_out(text: str) -> str:
    """The text with every span replaced by its kind in brackets (overlapping spans by the first kind)."""
    base, added = find(text)
    if not base and not added:
        return text
    out, done = [], 0
    for s, k, e in sorted(base + added):
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def redacted(text: Column) -> Column:
    """The text with its personal data blanked out; null stays null."""
    return each_text(text, lambda t: None if t is None else blank_out(_text(t)), pa.string())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))
