import hashlib
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import bpe, mixing, pii

from .test_simhash import brute_components, plain

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 %% 34", None, "src1", 8), (10**6 + 2, "", "en", None, 0), (10**6 + 3, "mail me at bob [at] example [dot] com today please", None, None, 50)],
        docs.schema,
    )
    docs = docs.union(extra)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]
    assert all(s.columns == stages[0].columns and s.schema == stages[0].schema for s in stages[:5])


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert before.keys() - after.keys() == {10**6, 10**6 + 1, 10**6 + 2}
    assert after[10**6 + 3].lang is not None


def test_one_of_each_component_stays(stages):
    docs = stages[1].orderBy("doc_id").collect()
    want = {docs[r].doc_id for r in brute_components([plain(d.text) for d in docs])}
    assert {r.doc_id for r in stages[2].collect()} == want and len(want) < len(docs)


def test_personal_data_goes(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert before.keys() == after.keys()
    assert after[10**6 + 3].text == "mail me at [EMAIL] today please"
    for i, r in after.items():
        base, _ = pii.find(before[i].text)
        assert (r.text == before[i].text) == (not base and i != 10**6 + 3)
        assert r.n_chars == len(r.text)


def test_mixing_takes_effect(stages):
    counts = Counter(r.doc_id for r in stages[4].collect())
    want = {r.doc_id: len(r["__shards"]) for r in mixing.mix(stages[3]).collect()}
    assert counts == Counter({k: v for k, v in want.items() if v}) and max(counts.values()) > 1


def test_tokens_equal_the_library(stages):
    path, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = rows(stages[4])
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stages[4].collect())
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, DATA).count() > 100
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    full = spark.read.parquet(f"{DATA}/documents.parquet")
    nulls = full.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in full.schema])
    nulls.write.parquet(f"{tmp_path}/nulls/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/nulls").count() == 0


def test_runs_at_once_keep_their_folders(spark):
    import threading

    from lexigrove.llm.common import drop_folder, saved, settled

    meet = threading.Barrier(2)
    got = {}

    def run(i):
        def make():
            first = saved(spark.range(i, i + 3), "first")
            meet.wait(30)
            second = saved(first.selectExpr("id * 10 AS id"), "second")
            meet.wait(30)
            return second

        done, path = settled(spark, make, f"run{i}")
        meet.wait(30)
        got[i] = (sorted(r.id for r in done.collect()), path)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [got[i][0] for i in range(2)] == [[0, 10, 20], [10, 20, 30]]
    assert all(f"/run{i}-" in got[i][1] for i in range(2))
    for _, path in got.values():
        drop_folder(spark, path)
