import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import sharding


def check(rows, out, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots, loads = defaultdict(list), Counter()
    for r in out:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return loads


def test_even_with_groups(spark):
    rng = random.Random(15)
    rows = [(i, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 400)))) for i in range(3000)]
    rows += [(10_000 + i, "same text " * 20) for i in range(1500)]
    rows += [(20_000 + i, f"pair {i // 2} " * 10) for i in range(400)] + [(30_000, None), (30_001, ""), (30_002, "x" * 9000), (30_003, "q"), (30_003, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)).withColumn("size", F.lit("?"))
    out = sharding.shard(df, 10).collect()
    loads = check(rows, out, 10)
    mean = sum(loads.values()) / 10
    assert max(loads.values()) - min(loads.values()) < 0.03 * mean
    at = defaultdict(set)
    for r in out:
        if 20_000 <= r.doc_id < 20_400:
            at[(r.doc_id - 20_000) // 2].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
    again = sharding.shard(df, 10).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 30_003} == {(r.doc_id, r.shard, r.slot) for r in out if r.doc_id != 30_003}


def test_group_fits_one_shard(spark):
    rng = random.Random(16)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(200))) for i in range(2000)]
    rows += [(5000 + i, "copied " * 30) for i in range(150)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    loads = check(rows, out, 8)
    assert len({r.shard for r in out if r.doc_id >= 5000}) == 1
    assert max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, "b")], [(i, "same") for i in range(100)], [(i, "x" * (10 ** (i % 6))) for i in range(30)]])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, sharding.shard(df, 4).collect(), 4)


def test_many_small_ranges_and_overfull_ones(spark, monkeypatch):
    rng = random.Random(19)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 300)))) for i in range(4000)]
    rows += [(9000, "one id, one text, many rows")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df, 5, range_rows=20).collect()
    loads = check(rows, out, 5)
    assert max(loads.values()) - min(loads.values()) < 0.03 * sum(loads.values()) / 5
    recs = sharding.saved(sharding.records(df.where("doc_id < 9000")), "records")
    total = recs.agg(F.sum("size")).first()[0]
    # A poor set of cuts: nearly all records are in one range.
    cuts = sharding.subdivided(recs, np.array([10, 20], np.int64), total / 100)
    sizes = recs.groupBy(sharding._range_of(cuts)("key").alias("r")).agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]
    assert sizes < 3 * total / 100


def test_placement_against_brute_force(spark):
    """Shards and slots recomputed from the records in order, without ranges, where there is no large group."""
    rng = random.Random(20)
    rows = [(i, f"{i} " + "x" * rng.randint(0, 80)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df, 6).collect()}
    recs = sorted(sharding.records(df).collect(), key=lambda r: (r.key, r.tie))
    total, so_far, want, slots = sum(r.size for r in recs), 0, {}, Counter()
    for r in recs:
        shard = min(5, int(so_far * 6 // total))
        want[r.doc_id] = (shard, slots[shard])
        slots[shard] += 1
        so_far += r.size
    assert sum(got[i][0] != want[i][0] for i in want) <= 6
    by_shard = defaultdict(list)
    for r in recs:
        by_shard[got[r.doc_id][0]].append(got[r.doc_id][1])
    assert all(s == list(range(len(s))) for s in by_shard.values())
