"""Plans stay as intended: pruned scans, no Python where SQL functions do, no product of two tables."""

import pytest

from lexigrove.plans import registry

from .oracle import DATA

PYTHON = ("chk4_sentence_chunks", "top1_dense", "top3_hybrid", "scr10_hybrid_with_facts", "scr14_all_modes", "udf2_cached_answers", "scr2_bm25", "scr15_naive_mode", "evl9_retrieval_check", "udf1_embed_missing", "udf5_extract")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(PYTHON)))
def test_no_python(spark, name):
    text = plan(registry.queries()[name](spark, DATA))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


def test_scan_is_pruned(spark):
    text = plan(registry.queries()["src1_scan"](spark, DATA))
    assert "GreaterThan(n_chars,100)" in text and "text" not in text.split("ReadSchema")[1].split(">")[0]


def test_keep_first_combines_before_the_shuffle(spark):
    text = plan(registry.queries()["win2_keep_first"](spark, DATA))
    assert "partial_min_by" in text and "Window" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(registry.queries()["top1_dense"](spark, DATA))
    assert "TakeOrderedAndProject" in plan(registry.queries()["agg3_top_entities"](spark, DATA))
