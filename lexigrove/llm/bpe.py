"""Byte-level BPE with a hierarchical-bitmap rank queue.

``encode`` / ``decode`` are DataFrame operators; :class:`RankQueueBPE` is the per-worker engine. Each
pre-token is a doubly linked list of byte positions. Candidate merges sit in one bucket per merge rank;
a two-level bitmap (256-bit leaves under one summary) marks the buckets in use, so the next rank is a
find-first-set on the summary and one on a leaf. Entries that a merge made obsolete stay in their bucket
and are skipped when they come up. A pre-token of n bytes costs O(n log n) whatever its length, where
rescanning all pairs would cost O(n^2).

Defined cases: a null text encodes as the empty one (no ids, empty bytes); text that is not valid UTF-8
is read with U+FFFD for the bad bytes; equal rows give equal rows; other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_rows, table, text_bytes

#: Pre-tokens held per generation of the memo (two generations), per worker.
MEMO = 270_000
#: Pre-tokens over this many characters are not kept in the memo.
MEMO_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class RankQueueBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.vocab = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in ranks.values()}
        self.find = regex.compile(pattern).findall
        self.leaves = (max(ranks.values(), default=0) >> 8) + 1
        self.kind = "H" if max(ranks.values(), default=0) < 1 << 16 else "L"
        self.memo = MEMO
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [self.ranks[piece[i : i + 1]] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        leaves = [0] * self.leaves
        summary = 0
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    leaves[r >> 8] |= 1 << (r & 255)
                    summary |= 1 << (r >> 8)
        while summary:
            high = (summary & -summary).bit_length() - 1
            leaf = leaves[high]
            r = high << 8 | ((leaf & -leaf).bit_length() - 1)
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                leaf &= leaf - 1
                leaves[high] = leaf
                if not leaf:
                    summary &= summary - 1
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                right = get(piece[i : after[k]], -1)
            else:
                right = -1
            pair[i] = right
            if right >= 0:
                if right in buckets:
                    heappush(buckets[right], i)
                else:
                    buckets[right] = [i]
                    leaves[right >> 8] |= 1 << (right & 255)
                    summary |= 1 << (right >> 8)
            p = before[i]
            if p >= 0:
                left = pair[p] = get(piece[p:k], -1)
                if left >= 0:
                    if left in buckets:
                        heappush(buckets[left], p)
                    else:
                        buckets[left] = [p]
                        leaves[left >> 8] |= 1 << (left & 255)
                        summary |= 1 << (left >> 8)
        out = []
        i = 0
        while i < n:
            j = after[i]
            out.append(self.ranks[piece[i:j]])
            i = j
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def decimal(self, ids) -> str:
        """The ids as decimal text, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))

    def _packed(self, token: str) -> bytes:
        """Ids of a pre-token as an array of numbers, memoised while short: far smaller than a tuple."""
        found = self.old.get(token)
        if found is None:
            found = array(self.kind, self.encode_piece(token.encode())).tobytes()
        if len(token) <= MEMO_CHARS:
            if len(self.young) >= self.memo:
                self.old, self.young = self.young, {}
            self.young[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        young, slow = self.young.get, self._packed
        ids = array(self.kind)
        ids.frombytes(b"".join([young(t) or slow(t) for t in self.find(text)]))
        return ids.tolist()


@lru_cache(maxsize=2)
def engine(path: str, pattern: str, memo: int = MEMO) -> RankQueueBPE:
    """One engine, with its memo, per worker process."""
    made = RankQueueBPE(load_ranks(path), pattern)
    made.memo = memo
    return made


def _text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids): the token ids of each whole text."""

    def run(keys, texts):
        bpe = engine(path, pattern)
        return keys, [bpe.encode(_text(t)) for t in texts]

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(df.select(F.col(id_col), text_bytes(text_col).alias("text")), run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text): the bytes of the ids read as UTF-8; null ids decode to the empty text."""

    def run(keys, ids):
        bpe = engine(path, pattern)
        return keys, [bpe.decode(x or ()).decode("utf-8", "replace") for x in ids]

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(df.select(F.col(id_col), F.col(ids_col).alias("ids")), run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """Encode, decode the ids, and return digests of both: n_tokens, ids_sha256, decoded_sha256, n_bytes.

    A worker holds twice ``memo`` pre-tokens: fewer take less memory and more time.
    """

    def run(keys, texts):
        bpe = engine(path, pattern, memo)
        counts, ids_hash, text_hash, sizes = [], [], [], []
        for t in texts:
            ids = bpe.encode(_text(t))
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(bpe.decimal(ids).encode()).hexdigest())
            whole = bpe.decode(ids)
            text_hash.append(hashlib.sha256(whole).hexdigest())
            sizes.append(len(whole))
        return keys, counts, ids_hash, text_hash, sizes

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(
        df.select(F.col(id_col), text_bytes(text_col).alias("text")),
        run,
        f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long",
    )


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every whole text of documents."""
    return round_trip(table(spark, sf_dir, "documents"), *default_vocabulary())
