import hashlib
import random

import pytest
import tiktoken

from lexigrove.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe.default_vocabulary()
    ranks = bpe.load_ranks(path)
    return bpe.RankQueueBPE(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_equals_library(pair):
    ours, theirs = pair
    rng = random.Random(1)
    alphabet = "abcdeſéüñß' \n\t\r0129٣Ⅷ.,!?-_漢字日本😀́​ \x1c\x85\xa0" + "ththeerin"
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert ours.encode(text) == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(ours.encode(text)).decode() == text


def test_every_code_point(pair):
    ours, theirs = pair
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert ours.encode(text) == theirs.encode_ordinary(text), hex(start)


def test_long_pre_tokens(pair):
    ours, theirs = pair
    rng = random.Random(2)
    for text in ("a" * 20_000, "the" * 9_000, " " * 5_000, "".join(rng.choice("etaoinsh") for _ in range(40_000))):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_random_rank_tables():
    rng = random.Random(3)
    for _ in range(60):
        ranks = {bytes([i]): i for i in range(256)}
        words = [bytes([i]) for i in b"abc"]
        for _ in range(40):
            new = rng.choice(words) + rng.choice(words)
            if new not in ranks:
                ranks[new] = len(ranks)
                words.append(new)
        ours = bpe.RankQueueBPE(ranks, r"[\s\S]+")
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert ours.encode_piece(piece) == brute(piece, ranks), piece


def brute(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_operator(spark):
    path, pattern = bpe.default_vocabulary()
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello wörld", "x"), (None, "a" * 3000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in bpe.round_trip(df, path, pattern).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert out[2].n_tokens == out[3].n_tokens == 0 and out[2].ids_sha256 == out[3].decoded_sha256 == empty
    assert out[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    ids = bpe.encode(df, path, pattern)
    back = bpe.decode(ids, path, pattern).collect()
    assert sorted((r.text for r in back), key=len) == ["", "", "Hello wörld", "Hello wörld", "a" * 3000]
    assert bpe.round_trip(df.limit(0), path, pattern).count() == 0
