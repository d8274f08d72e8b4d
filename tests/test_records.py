"""Line numbers of JSON lines over several splits, and file signatures against hashlib."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException

from lexigrove.operators import index_store
from lexigrove.sources import records, tables

SCHEMA = "a long, b string"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_several_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = set()
    for name in ("x.jsonl", "y.jsonl"):
        lines = []
        for i in range(300):
            kind = rng.random()
            good = json.dumps({"a": i, "b": "é" * rng.randrange(40)}, ensure_ascii=False)
            faults = ['{"a": 1', "3", "null", '{"a": "x"}', '{"a": 1} z', '{"a":1}{"a":2}', '[{"a":1}]', '{"a":1},{"a":2}']
            line = "  \t" if kind < 0.1 else rng.choice(faults) if kind < 0.2 else good
            if 0.1 <= kind < 0.2:
                want.add((name, i + 1, line))
            lines.append(line)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "x.jsonl" else ""))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = records.bad_lines(spark, str(tmp_path), SCHEMA).collect()
    assert {(os.path.basename(r.file), r.line, r.text) for r in got} == want and len(got) == len(want)
    kept = records.read_records(spark, str(tmp_path), SCHEMA, strict=False).collect()
    assert all(r.line == r.a + 1 for r in kept) and kept
    strict = records.read_records(spark, str(tmp_path), SCHEMA)
    with pytest.raises(PySparkException, match=r"line \d+ of .*[xy]\.jsonl is no record"):
        strict.count()


def test_good_and_empty_files(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"a": 1}\n\n{"b": "x", "c": 2}\n')
    assert [(r.a, r.b, r.line) for r in records.read_records(spark, str(path), SCHEMA).orderBy("line").collect()] == [(1, None, 1), (None, "x", 3)]
    assert records.bad_lines(spark, str(path), SCHEMA).isEmpty()
    (tmp_path / "e.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no records"):
        records.read_records(spark, str(tmp_path / "e.jsonl"), SCHEMA)


def _tree(data: bytes) -> str:
    level = [hashlib.sha256(data[i : i + records.LEAF]).hexdigest() for i in range(0, max(len(data), 1), records.LEAF)]
    for _ in range(records.LEVELS):
        level = [hashlib.sha256("".join(level[i : i + records.FANOUT]).encode()).hexdigest() for i in range(0, len(level), records.FANOUT)]
    return level[0]


def test_signatures(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    data = {"a.bin": rng.randbytes(9 << 20), "deep/b.bin": rng.randbytes(8 << 20), "deep/e.bin": b"", "c.txt": b"x"}
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    want = {(n, _tree(c), len(c)) for n, c in data.items() if c}
    root = str(tmp_path / "in")
    for whole, leaves in ((records.WHOLE, 256), (1 << 20, 1), (0, 2), (8 << 20, 256)):
        assert {tuple(r) for r in records.signatures(spark, root, whole=whole, leaves=leaves).collect()} == want
    assert {r.name for r in records.signatures(spark, root, "*.txt").collect()} == {"c.txt"}
    assert [tuple(r) for r in records.signatures(spark, f"{root}/deep/b.bin").collect()] == [("b.bin", _tree(data["deep/b.bin"]), 8 << 20)]
    assert tables.verify_checksum(spark, f"{root}/a.bin", hashlib.sha256(data["a.bin"]).hexdigest().upper())


def test_wide_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LEAF", 10)
    monkeypatch.setattr(records, "FANOUT", 3)
    (tmp_path / "f").write_bytes(bytes(range(200)))
    assert records.signatures(spark, str(tmp_path / "f")).first().digest == _tree(bytes(range(200)))


def test_two_sources_of_one_name_differ(spark, tmp_path):
    for side in ("x", "y"):
        (tmp_path / side).mkdir()
        (tmp_path / side / "t.json").write_text(f'{{"a": "{side}"}}')
    x, y = (tables.file_signature(spark, str(tmp_path / s)) for s in ("x", "y"))
    assert tables.is_current(x, x) and not tables.is_current(x, y)
    old = spark.createDataFrame([(1, "native", "m", "d", "t.json", "00", 1)], "version int, backend string, model string, data string, name string, sha256 string, size long")
    tables.write_table(old, index_store.Store(str(tmp_path / "i"), "m").manifest)
    assert index_store.load(spark, index_store.Store(str(tmp_path / "i"), "m"), str(tmp_path / "x"), str(tmp_path / "y")) is None
