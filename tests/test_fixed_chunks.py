"""Fixed-size chunks against plain loops; pages are cut into units once, before any window or shuffle."""

import random

import pytest

from lexigrove.operators import chunking


@pytest.mark.parametrize("method", ["token", "word"])
def test_windows_over_pages(spark, method):
    rng = random.Random(8)
    rows, docs = [], {}
    for d in range(12):
        for p in range(1, rng.randint(2, 9)):
            text = " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))) or None
            rows.append((f"d{d}", "co", 2022, p, text))
            docs.setdefault(f"d{d}", []).extend((p, w) for w in (text or "").split())
    rows.append((None, "co", 2022, 1, "lost"))
    df = spark.createDataFrame(rows, "doc_id string, company string, fiscal_year int, page_num int, clean_text string").repartition(3)
    out = chunking.fixed_chunks(df, method, 10, 3, 4)
    # What windows and shuffles read was written before: no page text is under them.
    assert "clean_text" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for d, words in docs.items():
        n = len(words)
        starts = [] if not n else [0] if n <= 10 else list(range(0, max(0, min(n - 1, n - 4)) + 1, 7))
        if n > 10 and starts[-1] + 7 < n and n - 10 > starts[-1]:
            starts.append(n - 10)
        for k, s in enumerate(starts):
            mine = words[s : s + 10]
            want.add((d, k, mine[0][0], mine[-1][0], " ".join(w for _, w in mine), len(mine), "co", 2022, "front_matter__01"))
    columns = ["doc_id", "chunk_index", "page_start", "page_end", "chunk_text", "word_count", "company", "fiscal_year", "section_id"]
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert len(got) == len(want) and set(got) == want
