from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import langid

DATA = "/root/testdata/sf0.01"


def test_ngrams_against_brute_force():
    for text in ("Über den Wölfen", "a", "", "1 2 3", "x1y  z", "ÀÉ ßs", "日本 語"):
        s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        want = Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]).strip())
        keys, counts = langid.ngrams(text.encode())

        def unpack(k):
            out = ""
            while k:
                out, k = chr(k & (1 << 21) - 1) + out, k >> 21
            return out

        assert {unpack(int(k)): int(c) for k, c in zip(keys, counts)} == dict(want), text


def test_out_of_place_distance():
    def key(g):
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    lists = {"de": ["e", "n", " d"], "en": ["e", "t", "th"]}
    keys = np.array(sorted({key(g) for x in lists.values() for g in x}), np.int64)
    ranks = np.array([[(lists[x].index(g) if g in lists[x] else -1) for x in lists] for g in sorted({g for x in lists.values() for g in x}, key=key)])
    model = langid.Profiles(list(lists), keys, ranks, np.arange(len(keys)), 3)
    assert model.predict(b"ttth")[0] == "en" and model.predict(b"nnn")[0] == "de"
    assert model.predict(b"12")[0] == "und" and model.predict(None) == ("und", 0.0)
    assert 0 <= model.predict(b"ttth")[1] <= 1


def test_held_out_accuracy(spark):
    out = langid.op7_langid(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = out.join(truth, "doc_id").where("held_out")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[1] > 100 and right[0] > 0.97
    assert out.select("doc_id").distinct().count() == truth.count()
    assert out.where("score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("langs", [[None, None], ["en", "de"]])
def test_edges(spark, langs):
    rows = [(1, "the house is here", langs[0], 1.0), (2, "das Haus ist da", langs[1], 1.0), (3, None, "en", 1.0), (4, "12 %%", "fr", 1.0), (5, "", None, 1.0)]
    rows += [rows[0], (6, "the " * 100_000, None, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(df)
    out = {r.doc_id: r for r in langid.predict(df, model, [F.col("doc_id")]).collect()}
    assert out[3].lang_pred == out[4].lang_pred == out[5].lang_pred == "und" and out[4].score == 0
    if langs[0]:
        assert out[1].lang_pred == out[6].lang_pred == "en" and out[2].lang_pred == "de"
    else:
        assert out[1].lang_pred == "und"
    assert langid.predict(df.limit(0), langid.fit(df.limit(0)), [F.col("doc_id")]).count() == 0


def test_copies_count_once(spark):
    texts = [(f"l{i:02d}", f"{'abcdefghijklmnopqrst'[i] * 3} one text of the language number {i}") for i in range(20)]
    once = spark.createDataFrame(texts, "lang string, text string")
    model = langid.fit(once.join(spark.range(30)), sample_docs=2)
    want = langid.fit(once, sample_docs=2)
    assert model.langs == want.langs == [lang for lang, _ in texts]
    assert (model.keys == want.keys).all() and (model.ranks == want.ranks).all() and (model.order == want.order).all()


def test_profiles_and_choice_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").limit(400).collect()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_docs=10**9)

    def grams(text):
        return dict(zip(*(x.tolist() for x in langid.ngrams(text.encode()))))

    totals = {}
    for lang, text in {(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None}:
        totals.setdefault(lang, Counter()).update(grams(text))
    profile = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: model.length]] for lang, c in totals.items()}
    assert model.langs == sorted(profile, key=lambda x: x.encode())
    kept = Counter()
    for lang, grams_ in profile.items():
        for g in grams_:
            kept[g] += totals[lang][g]
    order = {g: i for i, (g, _) in enumerate(sorted(kept.items(), key=lambda x: (-x[1], x[0])))}
    for r in rows[:120]:
        own = grams(r.text or "")
        if not own:
            assert model.predict((r.text or "").encode())[0] == "und"
            continue
        known = sorted((g for g in own if g in order), key=lambda g: (-own[g], order[g]))
        unknown = [g for g in own if g not in order]
        ranked = sorted(known + unknown, key=lambda g: (-own[g], order.get(g, len(order))))[: model.length]
        away = {}
        for lang in model.langs:
            rank = {g: i for i, g in enumerate(profile[lang])}
            away[lang] = sum(min(abs(rank[g] - i), model.length) if g in rank else model.length for i, g in enumerate(ranked))
        best = min(model.langs, key=lambda x: (away[x], x.encode()))
        lang, score = model.predict(r.text.encode())
        assert lang == best and score == pytest.approx(1 - away[best] / (model.length * len(ranked)))
