import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lexigrove.llm import alignment

PATHS = alignment.default_tokenizers()


def _byte_of():
    """The printable signs that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), by the libraries and plain loops."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    signs = _byte_of()
    cut = []
    for _, text in rows:
        mine = []
        if text:
            a = [(i, bytes(signs[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
            b = []
            for i in second.encode(text):
                piece = second.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends = []
                for toks in (a, b):
                    at, out = 0, []
                    for i, x in toks:
                        at += len(x)
                        out.append((i, at))
                    ends.append(out)
                shared = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
                last = 0
                for e in shared:
                    mine.append(tuple([i for i, at in x if last < at <= e] for x in ends))
                    last = e
        cut.append(mine)
    held = Counter()
    for mine in cut:
        held.update({(a, b) for x, y in mine for a in x for b in y})
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), mine in zip(rows, cut):
        pairs = [(a, b) for x, y in mine for a in x for b in y]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in mine)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if mine else ""
        out.append((i, sum(len(x) for x, _ in mine), sum(len(y) for _, y in mine), len(mine), len(pairs), digest, sum(held[p] == most[p[0]] for p in pairs), sum(held[p] for p in pairs)))
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row int, links string")
    out = alignment.align(df, *PATHS, **sizes).drop("links")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted(map(tuple, out.collect()), key=str)


ODD = [None, "", " ", "  ", "\n", "a", "  two  spaces \n\n\t x ", "naïve café — ½ ﬁ", "日本語のテキスト", "😀😃 ok", "<|endoftext|> <unk> <s>", "▁x", "é", "x" * 5000, " " * 3000 + "z", "12345 678.9", "\x00 \x01", " a　b", "don't we'll I'M"]


@pytest.mark.parametrize("bound", [10**6, 300, 0])
def test_against_loops(spark, bound):
    rng = random.Random(bound)
    words = ["the", "quick", "antidisestablishment", "über", "слово", "x1", "don't", "e-mail", "日本", "\n", "3.14", "aaa"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [rows[3], (None, rows[4][1]), (None, None)]
    assert run(spark, rows, most_broadcast=bound) == brute(rows)


def test_random_signs(spark):
    rng = random.Random(31)
    spans = [(32, 126), (160, 591), (0x370, 0x5FF), (0x900, 0xDFF), (0x2000, 0x2BFF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0x1F300, 0x1FAFF), (9, 13), (32, 32)]
    rows = [(i, "".join(chr(rng.randint(*rng.choice(spans))) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    assert run(spark, rows) == brute(rows)


def test_groups(spark):
    df = spark.createDataFrame([(1, "the antidisestablishment of 日本"), (2, None)], "doc_id long, text string")
    first = alignment.shared_ends(alignment.tokens(df, *PATHS))
    got = {r.id: r.groups for r in alignment.groups(first).collect()}
    spelled = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in got[1])
    want = {r[0]: r[5] for r in brute([(1, "the antidisestablishment of 日本")])}
    assert hashlib.sha256(spelled.encode()).hexdigest() == want[1] and got[2] == []


def test_plain_numbers(spark):
    """Arrays of links hold no nulls, so they are sorted as numbers; nothing by offset but the token that ends there; large groups at both ends and side by side."""
    texts = ["antidisestablishment", "x antidisestablishment antidisestablishment y", "日本 日本語 antidisestablishment", "a b c", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = alignment.tokens(df, *PATHS)
    assert tokens.columns == ["id", "a_ends", "a_at", "b_ends", "b_at"]
    found = alignment.links(alignment.shared_ends(tokens))
    assert not found.schema["links"].dataType.containsNull
    rows = sorted(found.collect())
    assert [tuple(r)[:6] for r in rows] == [r[:6] for r in brute(list(enumerate(texts)))]
    assert all(r.links == sorted(r.links) and len(r.links) == r.n_links for r in rows)


def test_pattern():
    first = [alignment._byte_level(PATHS[0], p)[0] for p in (public_tokenizers.PATTERN, alignment.PATTERN)]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(" \t\n\u3000\u00a0'sdmtlverSDé1½٣.,-日ab\x1c\u200b\u0301", k=rng.randint(0, 12)))
        assert first[0].encode_ordinary(text) == first[1].encode_ordinary(text)


def test_empty(spark):
    assert run(spark, []) == []
    bad = spark.sql("SELECT 1 AS doc_id, cast(X'61ff62' AS string) AS text")
    assert [tuple(r)[:6] for r in alignment.align(bad, *PATHS).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").collect()] == [(1, 0, 0, 0, 0, "")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_alignment(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
