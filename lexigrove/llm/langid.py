"""Language identification by rank-order profiles and out-of-place distance.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, word edges as a
blank) in falling order. A document's own list is compared with each profile: every n-gram costs the
difference of its two ranks, or the profile's length where the profile lacks it; the nearest profile names
the language. N-grams are packed into 63-bit integers and counted with a numpy sort, so the cost per
character doesn't depend on the number of languages.

Fitting uses a bounded sample: about ``sample_docs`` whole, distinct texts of each language (default
2000), chosen by their hash, so that the choice is the same on every run and at every size; copies count once, and a
language of fewer distinct texts is learned from all of them. Counts are added up per task before they are shuffled; the profiles (``length`` n-grams a language) reach the driver.

Ties: n-grams equally frequent in a document are ranked in the order of their total frequency in the
training sample (then absent ones, which cost the same anywhere); languages equally near are taken in
code-point order. Null text or text without letters gives ``und`` with score 0, as does a model without any
training language. The score is 1 - distance / largest possible distance. Repeated rows get equal results;
extra columns are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, each_text, over_rows, table, text_bytes

PROFILE = 400
SAMPLE_DOCS = 2000
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text in rising order, and their counts."""
    text = (raw or b"").decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(letter, points, _BLANK)
    points = points[letter | np.concatenate(([True], letter[:-1]))]
    one = np.concatenate(([_BLANK], points, [_BLANK])).astype(np.int64)
    two = one[:-1] << 21 | one[1:]
    three = two[:-1] << 21 | one[2:]
    grams = np.sort(np.concatenate((one, two, three)))
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    keys, counts = grams[starts], np.diff(np.append(starts, len(grams)))
    real = (keys != _BLANK) & (keys != (_BLANK << 21 | _BLANK))
    return keys[real], counts[real]


@dataclass
class Profiles:
    langs: list[str]
    keys: np.ndarray  # all n-grams of any profile, rising
    ranks: np.ndarray  # rank of each in each language, -1 where absent
    order: np.ndarray  # rank of each by total frequency
    length: int

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        keys, counts = ngrams(raw)
        if not len(keys) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        rank = (counts.max() - counts) * (len(self.keys) + 1) + np.where(known, self.order[at], len(self.keys))
        top = np.argpartition(rank, self.length)[: self.length] if len(rank) > self.length else np.arange(len(rank))
        top = top[np.argsort(rank[top], kind="stable")]
        known, at = known[top], at[top]
        mine, theirs = np.flatnonzero(known), self.ranks[at[known]]
        away = np.where(theirs < 0, self.length, np.minimum(np.abs(theirs - mine[:, None]), self.length))
        total = away.sum(axis=0) + self.length * int((~known).sum())
        best = int(np.argmin(total))
        return self.langs[best], float(1.0 - total[best] / (self.length * len(top)))


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE, sample_docs: int = SAMPLE_DOCS
) -> Profiles:
    """Learn profiles from the rows whose language isn't null (a bounded sample of each language)."""
    labelled = docs.select(F.col(lang_col).alias("lang"), text_bytes(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    # One number for each language, as the profiles are; a join would shuffle the texts.
    hashed = labelled.withColumn("hash", F.xxhash64("text"))
    sizes = {r.lang: r["count"] for r in hashed.select("lang", "hash").distinct().groupBy("lang").count().collect()}
    place = F.pmod("hash", F.lit(1 << 30)) / F.lit(float(1 << 30))
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang")) if sizes else F.lit(0)
    chosen = hashed.where(place * size < sample_docs).groupBy("lang", "hash").agg(F.min("text").alias("text")).drop("hash")

    def count(langs, texts):
        total: dict[str, list] = {}
        for lang, text in zip(langs, texts):
            total.setdefault(lang, []).append(ngrams(text))
        out: tuple[list, list, list] = ([], [], [])
        for lang, parts in total.items():
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
            out[0].extend([lang] * len(keys))
            out[1].extend(keys.tolist())
            out[2].extend(sums.tolist())
        return out

    counts = over_rows(chosen, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", place).where(F.col("rank") <= length).collect()
    langs = sorted({r.lang for r in rows}, key=lambda s: s.encode())
    keys = np.array(sorted({r.gram for r in rows}), np.int64)
    ranks = np.full((len(keys), len(langs)), -1, np.int64)
    total = np.zeros(len(keys), np.int64)
    for r in rows:
        at = int(np.searchsorted(keys, r.gram))
        ranks[at, langs.index(r.lang)] = r["rank"] - 1
        total[at] += r.n
    order = np.empty(len(keys), np.int64)
    order[np.lexsort((keys, -total))] = np.arange(len(keys))
    return Profiles(langs, keys, ranks, order, length)


def predict(df: DataFrame, model: Profiles, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, then lang_pred and score, for every row."""
    data = df.select(*keep, text_bytes(text_col).alias("__lx_text"))
    kept = data.schema.fields[:-1]

    def run(*columns):
        found = [model.predict(t) for t in columns[-1]]
        return (*columns[:-1], [f[0] for f in found], [f[1] for f in found])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return over_rows(data, run, schema)


def judged(model: Profiles, text: Column) -> Column:
    """A struct (lang_pred, score) for each text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])
    return each_text(text, lambda t: dict(zip(("lang_pred", "score"), model.predict(t))), kind)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents outside the held-out fold; predict every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_fold("doc_id", 5) != 0))
    return predict(docs, model, [F.col("doc_id"), (crc_fold("doc_id", 5) == 0).alias("held_out")]).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
