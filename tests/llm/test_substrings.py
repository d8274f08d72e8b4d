import hashlib
import random

import numpy as np
import pytest

from lexigrove.llm import substrings
from lexigrove.llm.substrings import K, NO_ID


def brute(rows):
    """(id, n_words, n_removed, digest) of each row, from all windows."""
    first, out = {}, []
    cut = [(NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for own, words in cut:
        for a in range(len(words) - K + 1):
            w = tuple(words[a : a + K])
            first[w] = min(own, first.get(w, own))
    for (i, _), (own, words) in zip(rows, cut):
        gone = [False] * len(words)
        for a in range(len(words) - K + 1):
            if first[tuple(words[a : a + K])] < own:
                gone[a : a + K] = [True] * K
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, h1 int")
    out = substrings.without_repeats(df, **sizes).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=str)


def corpus(rng, n=150, vocabulary=40):
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [" ".join(rng.choices(words, k=rng.randint(14, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 50)))]
        while rng.random() < 0.6:
            parts += [rng.choice(passages), " ".join(rng.choices(words, k=rng.randint(0, 20)))]
        rows.append((i * 7 % 1000, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(2000 + i, rows[i][1]) for i in range(20)]
    rows += [(rows[3][0], rows[5][1]), rows[4], rows[4], (None, rows[6][1]), (None, rows[6][1]), (3000, None), (3001, ""), (None, None)]
    rows += [(4000, "a " * 400), (4001, "a " * 13), (4002, "a " * 12), (4003, " ".join(f"z{i}" for i in range(3000)))]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"hot_share": 50, "sample_docs": 60}, {"bucket_bytes": 3000, "hot_share": 10**9}])
def test_against_all_windows(spark, sizes, monkeypatch):
    # The last sizes make buckets overfull, so that dealing is done again.
    monkeypatch.setattr(substrings, "PIECE_WORDS", 1000)
    rows = corpus(random.Random(len(sizes)))
    assert run(spark, rows, **sizes) == brute(rows)


def test_small_vocabulary(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 80)))) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_hot_passage_in_new_contexts(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"c{rng.randrange(10**9)}" for _ in range(15)) + " " + passage + " " + " ".join(f"c{rng.randrange(10**9)}" for _ in range(15))) for i in range(400)]
    assert run(spark, rows) == run(spark, rows, bucket_bytes=30_000) == brute(rows)


def test_a_string_sent_by_many_tasks_is_reported_once(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(12)
    found, _ = substrings.repeated_strings(df.select("id", substrings.text_bytes("text").alias("text")))
    assert found.count() == found.select("h1", "h2").distinct().count() > 0
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert substrings.without_repeats(df).count() == 0
    assert run(spark, [(1, None)]) == brute([(1, None)])


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(substrings, "_mixed", lambda h: h % np.uint64(5))
    a, b = " ".join(f"a{i}" for i in range(20)).encode(), " ".join(f"b{i}" for i in range(20)).encode()
    low, high = np.array([1, 2, 3]), np.array([1, 2, 3])
    text, lengths = a + b + b, np.array([len(a), len(b), len(b)])
    found = list(substrings._owners(low, high, lengths, text))
    assert [(s, o.tolist()) for s, o in found] == [(b, [2] * 8)]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = substrings.op11_substrings(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect()), key=str) == want
