import glob
import json
import random

import pyarrow.parquet as pq

from lexigrove.sources import tables


def rows(spark, n=500):
    rng = random.Random(9)
    return spark.createDataFrame([(rng.choice([None, *range(20)]), i) for i in range(n)], "k int, i int").repartition(7)


def test_files_in_order_of_names_are_sorted(spark, tmp_path):
    df = rows(spark)
    tables.write_sorted(df, f"{tmp_path}/t.parquet", ["k", "i"])
    files = sorted(glob.glob(f"{tmp_path}/t.parquet/part-*.parquet"))
    got = [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()]
    assert got == [tuple(r) for r in df.orderBy("k", "i").collect()]


def test_numbers_follow_the_order(spark):
    df = rows(spark)
    want = [tuple(r) for r in df.orderBy("k", "i").collect()]
    got = sorted((r.n, r.k, r.i) for r in tables.numbered_in_order(df, ["k", "i"], "n").collect())
    assert [g[0] for g in got] == list(range(1, len(want) + 1)) and [g[1:] for g in got] == want
    assert tables.numbered_in_order(df.limit(0), ["k"], "n", 0).count() == 0


def test_records_have_null_for_what_is_no_number(spark):
    df = spark.createDataFrame([(1, float("nan"), None), (2, float("inf"), "x"), (3, 1.5, "é")], "a int, b double, c string")
    assert [json.loads(r.record) for r in tables.json_records(df).collect()] == [{"a": 1, "b": None, "c": None}, {"a": 2, "b": None, "c": "x"}, {"a": 3, "b": 1.5, "c": "é"}]
