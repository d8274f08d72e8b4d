import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import lmtrie


def test_elias_fano():
    rng = np.random.default_rng(17)
    for n, universe in ((0, 10), (1, 1), (1, 1 << 62), (500, 600), (3000, 1 << 40), (2000, 1 << 63), (64, 64)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
        ef = lmtrie.EliasFano.build(values, universe)
        if len(values):
            assert (ef.get(np.arange(len(values))) == values).all()
        ask = np.concatenate((values, rng.integers(0, universe, 300, dtype=np.uint64)))
        want = {int(v): i for i, v in enumerate(values)}
        assert ef.find(ask).tolist() == [want.get(int(v), -1) for v in ask]
    clustered = np.unique(np.concatenate((rng.integers(0, 1 << 50, 300), np.arange(10_000) + (1 << 49)))).astype(np.uint64)
    ef = lmtrie.EliasFano.build(clustered, 1 << 50)
    assert (ef.find(clustered) == np.arange(len(clustered))).all() and (ef.find(clustered + np.uint64(1)) >= -1).all()
    repeated = np.array([0, 0, 3, 3, 3, 9], np.uint64)
    assert (lmtrie.EliasFano.build(repeated, 10).get(np.arange(6)) == repeated).all()


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows, discount=0.75, order=3):
    train = [t for i, t in rows if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2]
    uni, bi, tri = Counter(), Counter(), Counter()
    for t in train:
        seq = tokens(t)
        uni.update(seq)
        bi.update(zip([None] + seq[:-1], seq))
        tri.update(zip([None] + seq[:-2], seq[:-1], seq[1:]))
    n, v = sum(uni.values()), len(uni)
    kids, grandkids = Counter(c for c, _ in bi), Counter((a, b) for a, b, _ in tri)
    out = []
    for i, t in rows:
        seq = tokens(t)
        base = [(uni[w] + 1) / (n + v + 1) for w in seq]
        full = []
        for at, (c, w, b) in enumerate(zip([None] + seq[:-1], seq, base)):
            p = b if not uni[c] else max(bi[c, w] - discount, 0) / uni[c] + discount * kids[c] / uni[c] * b
            a = (seq[at - 2] if at > 1 else None, c)
            if order > 2 and at and bi[a]:
                p = max(tri[(*a, w)] - discount, 0) / bi[a] + discount * grandkids[a] / bi[a] * p
            full.append(p)
        out.append((i, zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2, len(seq), sum(uni[w] > 0 for w in seq), n, sum(map(math.log10, base)), sum(map(math.log10, full))))
    return out


def run(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    model = lmtrie.train(df.where(lmtrie.crc_fold("doc_id", 7) != 2), lmtrie.local_path(lmtrie.new_folder(spark, "lm")), discount=0.75, shard_tokens=400)
    out = lmtrie.score(df, model, [F.col("doc_id"), (lmtrie.crc_fold("doc_id", 7) == 2).alias("held_out")])
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return model, out.collect()


def test_against_brute_force(spark):
    rng = random.Random(18)
    words = ["the", "The", "a", "É", "é", "x\x1cy", "of", "zz"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [40, 5, 20, 3, 3, 1, 20, 1] + [1] * 60, k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "only new words here"), (None, "the of"), rows[3], (1003, "the " * 3000)]
    model, out = run(spark, rows)
    assert model.shards > 4 and model.hot
    want = Counter((w[:5], round(w[5], 6)) for w in brute(rows))
    assert Counter(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), round(r.base_score, 6)) for r in out) == want
    full = {w[0]: w[6] for w in brute(rows)}
    for r in out:
        assert abs(r.score - full[r.doc_id]) < 0.02 * r.n_tokens, r
    assert model.entries[1] > model.entries[0] > 500
    # The same model scores at order 2; probabilities over all tokens add up to one.
    df = spark.createDataFrame(rows, "doc_id long, text string")
    two = {w[0]: w[6] for w in brute(rows, order=2)}
    for r in lmtrie.score(df, model, [F.col("doc_id")], order=2).collect():
        assert abs(r.score - two[r.doc_id]) < 0.02 * r.n_tokens, r


def test_triples_merge_in_steps(monkeypatch):
    rng = np.random.default_rng(3)
    want, triples = Counter(), lmtrie.Triples()
    monkeypatch.setattr(lmtrie, "MERGED_HELD", 300)
    for _ in range(20):
        rows = Counter(map(tuple, rng.integers(0, 9, (100, 2)).tolist()))
        want.update(rows)
        part = sorted(rows)
        keys, following = (np.array(c, np.uint64) for c in zip(*part))
        triples.add(lmtrie._packed_triples(keys << np.uint64(33), following, np.array([rows[r] for r in part])))
    keys, following, counts = triples.merged()
    assert list(zip((keys >> np.uint64(33)).tolist(), following.tolist())) == sorted(want) and counts.tolist() == [want[r] for r in sorted(want)]


def test_distinct_rows():
    rng = np.random.default_rng(4)
    columns = [rng.integers(0, 7, 500) for _ in range(3)]
    for size in (7, 1 << 30):
        found, counts = lmtrie.distinct_rows(columns, size)
        want = Counter(zip(*(c.tolist() for c in columns)))
        assert list(zip(*(c.tolist() for c in found))) == sorted(want) and counts.tolist() == [want[r] for r in sorted(want)]


@pytest.mark.parametrize("rows", [[], [(6, "a b")], [(1, None)]])
def test_small(spark, rows):
    _, out = run(spark, rows)
    for r, w in zip(sorted(out), sorted(brute(rows))):
        assert r[:5] == w[:5] and r.base_score == pytest.approx(w[5]) and r.score == pytest.approx(w[6], abs=0.01)


def test_better_than_base_on_held_out_text(spark):
    out = lmtrie.op8_lm_score(spark, "/root/testdata/sf0.01").where("held_out")
    base, full, n = out.select(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    print(base / n, full / n)
    assert full > base
