import random

import numpy as np
import pytest
import xxhash

from lexigrove.llm import simhash


def plain(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["A", "b", "É", " ", "\n", "\x1c", "\xa0", "c"]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == plain(text), repr(text)


def brute_components(fps, bits=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def noisy(rng, n):
    centres = [rng.getrandbits(64) for _ in range(12)]
    return [rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)]


def test_masks_lose_no_pair():
    rng = random.Random(8)
    for distinct in (10, 10_000, 10**6, 10**8):
        masks = simhash.block_masks(distinct, 4)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in masks)


@pytest.mark.parametrize("bucket_rows", [20_000, 10])
def test_links_and_components_against_all_pairs(spark, bucket_rows, monkeypatch):
    rng = random.Random(9)
    fps = list(dict.fromkeys(noisy(rng, 500)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    monkeypatch.setattr(simhash, "_PAIRWISE", 4)
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4, bucket_rows)).collect()}
    want = brute_components(fps)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(signed[i])
    for members in groups.values():
        assert {roots.get(m, m) for m in members} == {min(members)}


def test_overfull_stream():
    fps = np.arange(50, dtype=np.int64) << 40
    import pyarrow as pa

    def batches():
        for at in range(0, 50, 7):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(np.arange(at, min(at + 7, 50)) < 40, 1, 2)), pa.array(fps[at : at + 7])], names=["key", "fp"])

    rows = [r for b in simhash._bucket_links(4, 12)(batches()) for r in b.to_pylist()]
    assert sorted(r["b"] for r in rows if r["over"]) == sorted(fps[:40].tolist())


def test_operator(spark):
    rng = random.Random(10)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(200)) for _ in range(20)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randint(0, 199)] = "x"
        rows.append((1000 - i, " ".join(words), "s"))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, " \n", "s"), (5003, "one", "s"), (5004, "ONE", "s"), rows[0], (None, "q w e", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    assert got == sorted(((i, f, least.get(r)) for (i, _, _), f, r in zip(rows, fps, roots)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, {least.get(r) for r in roots}))


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(23)
    path = [(i, i + 1) for i in range(200)]
    rng.shuffle(path)
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(5000 - i, 5000) for i in range(300)]
    mess = [(rng.randint(10_000, 10_400), rng.randint(10_000, 10_400)) for _ in range(300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in path + star + mess] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_one_row_stays_of_each_component(spark):
    rng = random.Random(12)
    words = [rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(400)]
    one, near = " ".join(words), None
    for i in range(400):
        text = " ".join([*words[:i], "x", *words[i + 1 :]])
        if 0 < (plain(one) ^ plain(text)).bit_count() <= 4:
            near = text
    other = "some text that is far away from all of these"
    for ids in ((None, None, None), (5, 5, 7), (None, 5, 5)):
        rows = [(ids[0], one), (ids[1], near), (ids[2], one), (9, other)]
        kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        near_kept = [r for r in kept if r.text != other]
        assert len(kept) == 2 and len(near_kept) == 1 and near_kept[0].doc_id == min((i for i in ids if i is not None), default=None)
