import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexigrove.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuild(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        leaves = [k for k in below if not any(x[: len(k)] == k and len(x) > len(k) for x in below)]
        kept = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children), len(leaves), kept, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, id string, depth int")


def run(spark, rows, **sizes):
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame(spark, rows))), **sizes)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=str)


def corpus(rng):
    rows = []
    for c in rng.sample(range(0, 400), 160):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice("ab") * (1 + t % 3)))
    opening = [("system", "be kind"), ("user", "hello"), ("assistant", "hi"), ("user", "go on"), ("assistant", "ok"), ("user", "so"), ("assistant", "well")]
    for c in range(1000, 1060):  # many share seven turns, and many are equal
        told = opening + ([("user", rng.choice("xyz"))] if rng.random() < 0.6 else [])
        rows += [(c, t, r, x) for t, (r, x) in enumerate(told)]
    rows += [(5000, 0, None, None), (5001, None, "user", None), (5001, 3, "user", "a"), (None, 1, "user", "lost"), (5002, 1, "a", "b"), (5002, 2, "a", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_turns", [prefix_trie.LOCAL_TURNS, 40, 1])
def test_against_all_prefixes(spark, local_turns, monkeypatch):
    rows = corpus(random.Random(local_turns))
    assert run(spark, rows, local_turns=local_turns) == brute(rebuild(rows))


def test_finish_against_all_prefixes():
    rng = random.Random(3)
    for _ in range(20):
        seqs = {tuple(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)}
        rows = [([("r", x) for x in s], [1] * len(s), 1, i, hashlib.sha256(str(i).encode()).hexdigest()) for i, s in enumerate(seqs)]
        want = [r for r in brute({r[3]: r[0] for r in rows}) if r[1] > 0]
        got = [r if r[1] > 1 else (*r[:2], 0, *r[3:]) for r in prefix_trie.finish(rows, 0)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_digests_over_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 50)
    rng = random.Random(4)
    pairs = [(1, 1, c) for c in range(3000)] + [(rng.randrange(40), 2, c) for c in range(500)]
    want = defaultdict(list)
    for a, b, c in pairs:
        want[a, b].append(c)
    df = spark.createDataFrame(pairs, "k1 long, k2 long, conv_id long").orderBy(F.rand(1))
    got = {(r.k1, r.k2): r.ends for r in prefix_trie._ends(df, 6).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_edges(spark):
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
    # The only turn is replaced by that of a conversation that isn't there: a root that is a leaf.
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    rows = [(lone, 0, "user", "x")]
    assert run(spark, rows) == brute(rebuild(rows)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    rows = [(7, None, "user", "a" * 100_000), (7, 1, None, None), (7, 1, None, None)] + [(8, t, "user", "b") for t in range(500)]
    assert run(spark, rows) == brute(rebuild(rows))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op12_prefix_trie(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuild(rows))
