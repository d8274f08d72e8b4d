"""Repetition quality rules: coverage by duplicated n-grams and lines, from rolling hashes in numpy.

Words get dense ids within a document. ``h[i] = sum(mix(id[i + j]) * B**(n - 1 - j)) mod 2**64`` is the
hash of the n-gram at word i; each length is rolled out of the next shorter one, so a length costs one
multiply-add over the document. Windows with equal hashes are adjacent after a sort; every such pair is
then compared word by word, so that a collision cannot count. Marked windows cover words, and covered
words give characters.

Rules (characters inside repeated material over characters in words, limits of the published
"MassiveText" quality rules): duplicated lines 0.20, duplicated 5- to 10-grams 0.15, 0.14, 0.13, 0.12,
0.11, 0.10. The share of the *number* of lines is reported but not judged: one repeated heading in a text
of three lines would exceed it. For the coverage rules the first occurrence doesn't count, only the repeats. The base rules come from the contract: at least 10 words, and at most 20 % of the words in
5-word windows found twice or more (here the first occurrence counts).

Defined cases: a null or empty text has no words and fails the base; ties don't arise; whole texts are
read whatever their length, one document at a time; extra columns are never looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_rows, table, text_bytes

#: Fixed limits of the published rules: n-gram length -> largest share of characters in repeats.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def code_points(raw: bytes) -> int:
    return len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))


def repeats(ids: np.ndarray, lengths) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: (windows found twice or more, windows that repeat an earlier one), as masks."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    total = len(ids)
    with np.errstate(over="ignore"):
        unit = ids.astype(np.uint64) + np.uint64(1)
        unit = (unit ^ (unit >> np.uint64(33))) * _MIX
        unit ^= unit >> np.uint64(29)
        rolled, have = unit, 1
        for n in sorted(lengths):
            size = total - n + 1
            if size < 2:
                out[n] = (np.zeros(max(size, 0), bool),) * 2
                continue
            while have < n:
                rolled = rolled[: total - have] * _BASE + unit[have:]
                have += 1
            order = np.argsort(rolled, kind="stable")
            ranked = rolled[order]
            same = np.flatnonzero(ranked[1:] == ranked[:-1])
            first, second = order[same], order[same + 1]
            for j in range(n):
                true = ids[first + j] == ids[second + j]
                if not true.all():
                    first, second = first[true], second[true]
            again = np.zeros(size, bool)
            again[second] = True
            found = again.copy()
            found[first] = True
            out[n] = (found, again)
            if not len(second):
                for longer in (m for m in lengths if m > n):
                    out[longer] = (np.zeros(max(total - longer + 1, 0), bool),) * 2
                break
    return out


def covered(windows: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside a marked window of n words."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(windows)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:total]) > 0


def measure(raw: bytes | None) -> dict:
    raw = raw or b""
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = np.zeros(len(seen), np.int64)
    for w, i in seen.items():
        chars[i] = len(w) if w.isascii() else code_points(w)
    chars = chars[ids] if len(ids) else np.zeros(0, np.int64)
    total = int(chars.sum())

    lines: set[bytes] = set()
    n_lines = dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        stripped = line.split()
        if stripped:
            n_lines += 1
            if line in lines:
                dup_lines += 1
                dup_line_chars += sum(len(w) if w.isascii() else code_points(w) for w in stripped)
            lines.add(line)

    marks = repeats(ids, NGRAM_LIMITS)
    repeat_words = int(covered(marks[5][0], 5, len(ids)).sum())
    shares = {
        n: (float(chars[covered(again, n, len(ids))].sum()) / total if total and again.any() else 0.0)
        for n, (_, again) in marks.items()
    }
    base_failed = len(words) < 10 or 100 * repeat_words > 20 * len(words)
    line_share = dup_lines / n_lines if n_lines else 0.0
    line_char_share = dup_line_chars / total if total else 0.0
    kept = (
        not base_failed
        and line_char_share <= LINE_CHARS_LIMIT
        and all(shares[n] <= limit for n, limit in NGRAM_LIMITS.items())
    )
    return {
        "n_words": len(words),
        "word_chars": total,
        "n_symbols": sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words,
        "base_failed": base_failed,
        "kept": kept,
        "dup_line_share": line_share,
        "dup_line_char_share": line_char_share,
        "max_ngram_share": max(shares.values()),
    }


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, dup_line_share double, dup_line_char_share double, max_ngram_share double"
)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, measures, base_failed, kept) for each row of ``df``."""

    def run(keys, texts):
        found = [measure(t) for t in texts]
        names = [f.split()[0] for f in FIELDS.split(",")]
        return (keys, *([x[n] for x in found] for n in names))

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(df.select(F.col(id_col), text_bytes(text_col).alias("text")), run, f"`{id_col}` {kind}, {FIELDS}")


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict on every whole text of documents."""
    return quality(table(spark, sf_dir, "documents"))
