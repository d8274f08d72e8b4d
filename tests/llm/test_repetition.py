import random
import re
from collections import Counter

import numpy as np

from lexigrove.llm import repetition


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def test_base_against_brute_force():
    rng = random.Random(4)
    alphabet = ["a", "b", "é", "ü#", "\n", "\n", "\t", "c", "\x0b", "\x1c", "\x85", "\xa0", "🙂"]
    for _ in range(400):
        text = " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        m = repetition.measure(text.encode())
        got = tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == plain(text), repr(text)


def test_coverage_against_brute_force():
    rng = random.Random(5)
    for _ in range(100):
        ids = np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 60))], np.int64)
        for n, (found, again) in repetition.repeats(ids, [2, 5, 6, 10]).items():
            grams = [tuple(ids[i : i + n]) for i in range(max(0, len(ids) - n + 1))]
            counts, seen = Counter(grams), set()
            assert list(found) == [counts[g] > 1 for g in grams]
            for g, a in zip(grams, again):
                assert a == (g in seen)
                seen.add(g)


def test_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    looped = " ".join(["buy this very cheap watch today only"] * 30)
    lines = "\n".join(["same line of text here"] * 4 + [f"other line number {i} stands here" for i in range(5)])
    rows = [(1, clean, 1), (2, looped, 1), (3, None, 1), (4, "", 1), (5, lines, 1), (1, clean, 1), (6, clean + " " + "w" * 300_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = repetition.quality(df).collect()
    kept = {(r.doc_id, r.kept) for r in out}
    assert kept == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)}
    assert len(out) == 7 and repetition.quality(df.limit(0)).count() == 0
