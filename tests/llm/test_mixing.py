import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrove.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Proportional shares, excess reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, stopped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in stopped]
        if not free:
            return stopped
        shares = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if shares[s] > cap * sizes[s]]
        if not over:
            return stopped | shares
        for s in over:
            stopped[s] = float(cap * sizes[s])
            left -= stopped[s]


def test_targets(spark):
    rng = random.Random(11)
    for trial in range(6):
        names = ["a", "b", "é", "Z", "\U0001f600", "｡", None, "zz"][: rng.randint(1, 8)]
        sizes = {n: rng.choice([0, 1, 10, 100, 10_000]) for n in names}
        df = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source string, source_size long, docs long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9), (trial, sizes)


def test_split_is_exact_and_disjoint(spark):
    quotas = [(0, 17), (1, 0), (2, 300), (3, 1)]
    df = spark.createDataFrame(quotas, "ord int, quota long")
    for shards in (1, 2, 5, 8):
        rows = mixing.split(df, shards).collect()
        by_source, by_shard = Counter(), Counter()
        for r in rows:
            by_source[r.ord] += r.n
            by_shard[r.shard] += r.n
        assert all(by_source[o] == q for o, q in quotas)
        assert len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_counts_are_hypergeometric(spark):
    for total, good, drawn in ((20, 12, 10), (9, 4, 8), (5000, 40, 2500), (300_000, 200_000, 90_000)):
        n = 4000
        value = F.expr(mixing._hypergeometric(f"{total}L", f"{good}L", f"{drawn}L", "xxhash64(7, id)"))
        counts = {r.x: r["count"] for r in spark.range(n).select(value.alias("x")).groupBy("x").count().collect()}
        mean, share = drawn * good / total, good / total
        var = drawn * share * (1 - share) * (total - drawn) / (total - 1)
        assert min(counts) >= max(0, drawn - (total - good)) and max(counts) <= min(drawn, good)
        got = sum(x * c for x, c in counts.items()) / n
        assert abs(got - mean) < 4 * math.sqrt(var / n)
        assert abs(sum((x - got) ** 2 * c for x, c in counts.items()) / n - var) < 0.12 * var
        if total == 20:
            for x in range(2, 11):
                p = math.comb(good, x) * math.comb(total - good, drawn - x) / math.comb(total, drawn)
                assert abs(counts.get(x, 0) - n * p) < 5 * math.sqrt(n * p + 1), x


def docs(spark, rng, n=900):
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 6 + ["mid", "tiny", None])
        rows.append((i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 60))), source, "x"))
    rows += [(5000, None, "nulls", "x"), (5001, "one giant " * 900, "giant", "x"), (5002, "", "nulls", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string"), rows


def test_operator(spark):
    df, rows = docs(spark, random.Random(12))
    out = mixing.mix(df, block_docs=16, shards=6).collect()
    sizes = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    totals, biggest = Counter(), defaultdict(int)
    for i in sizes:
        totals[source[i]] += sizes[i]
        biggest[source[i]] = max(biggest[source[i]], sizes[i])
    want = brute_targets(totals)
    taken, shards = Counter(), Counter()
    assert len(out) == len(rows)
    for r in out:
        s = source[r.doc_id]
        assert r["__size"] == sizes[r.doc_id] and r["__source_size"] == totals[s]
        assert r["__target"] == pytest.approx(want[s])
        assert len(r["__shards"]) <= 3 and all(0 <= x < 6 for x in r["__shards"])
        taken[s] += sizes[r.doc_id] * len(r["__shards"])
        shards.update(r["__shards"])
    for s in totals:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6, s
    assert len(shards) == 6
    again = {(r.doc_id, tuple(r["__shards"])) for r in mixing.mix(df, block_docs=16, shards=6).collect()}
    assert again == {(r.doc_id, tuple(r["__shards"])) for r in out}


def test_sample_and_empty(spark):
    df, rows = docs(spark, random.Random(13), 200)
    out = mixing.sample(df)
    assert out.columns == df.columns
    counts = Counter(r.doc_id for r in out.collect())
    want = {r.doc_id: len(r["__shards"]) for r in mixing.mix(df).collect()}
    assert all(counts.get(i, 0) == n for i, n in want.items())
    assert mixing.mix(df.limit(0)).count() == 0
    placed = mixing.sharded(df, shards=4)
    assert placed.count() == out.count() and placed.columns[:4] == df.columns


def test_no_python_in_the_plan(spark):
    df, _ = docs(spark, random.Random(14), 50)
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, "a b c", None, None), (1, "a b", "s", None)] + [(2, "x y z", "s", None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    assert {r["__source_size"] for r in out if r.doc_id is None} == {3} and {r["__source_size"] for r in out if r.doc_id} == {17}
    assert len({len(r["__shards"]) for r in out if r.doc_id == 2}) <= 2  # equal rows differ by one draw at most
    assert all(len(r["__shards"]) <= 3 for r in out)
    assert mixing.sample(df).columns == df.columns


def brute_counts(rows, plan, cap=3, block_docs=16):
    """How often each place (source, u) is taken: whole epochs, then rows in order while that brings the sum nearer."""
    out = Counter()
    for source, mine in rows.items():
        target, size = plan[source], sum(n for _, n in mine)
        epochs = min(cap, int(target // size)) if size else 0
        rest = target - epochs * size if epochs < cap else 0.0
        for u, _ in mine:
            out[source, u] += epochs
        so_far = 0
        for u, n in sorted(mine) if rest > 0 else []:
            if so_far + n / 2 > rest or so_far + n == size and n == 0:
                break
            out[source, u] += 1
            so_far += n
    return out


def test_draws_against_brute_force(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(["w"] * rng.randint(1, 50)), rng.choice(["a"] * 5 + ["b", "c", "d"])) for i in range(700)]
    rows += [rows[0]] * 40 + [rows[5]] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 1.0):
        out = mixing.mix(df, block_docs=16, share=share, keep=["doc_id", "source"]).collect()
        by_source, plan, got = defaultdict(list), {}, Counter()
        for r in out:
            by_source[r.source].append((r["__u"], r["__size"]))
            plan[r.source] = r["__target"]
            got[r.source, r["__u"]] += len(r["__shards"])
        want = brute_counts(by_source, plan)
        assert all(got[key] == want[key] for key in got.keys() | want.keys())


def test_equal_rows_reach_the_target(spark):
    rows = [(1, "a b c", "x")] * 200 + [(i, "v w", "y") for i in range(10, 310)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, weights=(1, 1), share=0.5, keep=["doc_id", "source"]).collect()
    assert {r["__target"] for r in out} == {300.0}
    assert sum(3 * len(r["__shards"]) for r in out if r.source == "x") == 300
    assert sum(2 * len(r["__shards"]) for r in out if r.source == "y") == 300
    assert mixing.sample(df, weights=(1, 1), share=0.5).groupBy("source").count().where("source = 'x'").first()["count"] == 100


def test_never_over_the_cap(spark):
    rows = [(i, "a b", "small") for i in range(5)] + [(100 + i, "", "small") for i in range(40)] + [(200 + i, "w " * 50, "zbig") for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=2).collect()
    assert max(len(r["__shards"]) for r in out) <= 3
    assert sum(r["__size"] * len(r["__shards"]) for r in out if r.doc_id < 100) == 30


def test_many_sources(spark):
    rows = [(i, "a b c", f"s{i % 700:04d}") for i in range(1400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=4).collect()
    assert len(out) == 1400 and {len(r["__shards"]) for r in out} <= {0, 1, 2, 3}


def test_clashing_names(spark):
    names = ["doc_id", "text", "source", "__shard", "__shards", "__size", "__place", "u", "shard", "size", "copies"]
    df = spark.createDataFrame([(i, "a b", "s", *range(8)) for i in range(20)], names)
    assert mixing.sample(df).columns == names and mixing.sample(df).first()["__shards"] == 1
    assert mixing.sharded(df, shards=3).columns == [*names, "__shard_", "__place_"]
