"""Corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Every stage is a function (spark, docs, sf_dir) -> DataFrame on all that its predecessor kept. All but the last
return the columns of ``docs``, whatever else these are; an empty table stays empty. :func:`run` writes each stage to the
shared folder and reads it again, so a lost executor repeats part of one stage only; what it no longer needs is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.llm import bpe, langid, mixing, pii, simhash
from lexigrove.llm.common import drop_folder, settled, table

#: Texts whose n-grams fit no language profile better than this are rejected, as are texts without letters.
LEAST_LANGUAGE_SCORE = 0.30
#: Pre-tokens a worker remembers in each of two generations: fewer than alone, as workers also keep what other stages need.
PIPELINE_MEMO = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or in no learned language; fill in a missing ``lang``.

    Null and empty texts are rejected. Without any labelled row nothing can be learned, and only texts
    without letters go.
    """
    model = langid.fit(docs)
    seen = docs.withColumn("__lx_found", langid.judged(model, F.col("text")))
    if not model.langs:
        return seen.where(F.regexp_like("text", F.lit(r"\p{L}"))).select(*docs.columns)
    kept = seen.where((F.col("__lx_found.lang_pred") != "und") & (F.col("__lx_found.score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lx_found.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one with the least doc_id.

    Null and empty texts are copies of one another. A null id comes after all others; of rows equal in id and
    fingerprint one stays, whichever.
    """
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, disguised or not, by its kind in brackets; n_chars follows. No row is dropped.

    A null text stays null, and its n_chars is null; of overlapping spans the first gives the kind; repeated rows are
    treated alike.
    """
    out = docs.withColumn("text", pii.redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw each document as often as its source's target weight asks (0 to 3 times).

    A null source is a source of its own; null and empty texts have no words; rows equal in id and text differ by one
    draw at most.
    """
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each drawn document, as digests, with the digest of what they decode to.

    A null text is the empty one; repeated rows, such as documents drawn more than once, give a row each.
    """
    return bpe.round_trip(docs, *bpe.default_vocabulary(), memo=PIPELINE_MEMO)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("tokens", tokens),
]

#: Profiles, fingerprints over XXH64, transducers and BPE merges can't be put in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if folder is not None:
            drop_folder(spark, folder)
        docs, folder = done, path
    return STAGES[-1][1](spark, docs, sf_dir)
