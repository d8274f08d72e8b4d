"""N-gram language model of order 3 in an Elias-Fano trie, sharded and memory-mapped.

Level 1 holds the distinct training tokens: their 64-bit hashes, rising, as an Elias-Fano sequence, and their
counts. A token's id is its place in that order. Level 2 holds, for each context, its successors: contexts are an
Elias-Fano sequence of ids, their first children a monotone Elias-Fano sequence of pointers, and the
successors one Elias-Fano sequence of (place of the context) * V + id, so that a successor is found relative to its
context with one successor search: two selects give the few entries with its high bits, a bisection of the low
bits ends it. Level 3 holds the successors of level 2's entries in the same way, relative to a bigram's place in its shard;
its pointers run along level 2 itself, so it needs no contexts of its own. Each entry has one byte: its smoothed
probability, quantised in log space with the mean of each bin; entries of level 2 have another one for their back-off
mass. The number of children of a token (a difference of two pointers) gives its back-off mass.

p(w | b) = max(count(b w) - D, 0) / count(b) + D * children(b) / count(b) * p(w), and p(w | a b) likewise over p(w | b):
absolute discounting, interpolated, over an add-one unigram p(w). D is n1 / (n1 + 2 n2) of the shard's entries seen once
and twice, for each level, unless it is given. The first token's context is the end token alone, the second's is both; an
unknown context has no part of its own.

Building. Tasks count tokens, then trigrams (which bigrams follow from), each with an end mark, in bounded dictionaries and
arrays and pass on sorted, compressed blocks for each shard; a shard's blocks meet in one task as a stream, are
merged in bounded steps, and become one file in the shared folder (written aside and renamed, so repeated tasks do no
harm). Tokens are dealt by hash, bigrams with their successors by context; contexts with a large share of the corpus are
dealt by successor too, so what a shard gets more than its share of is at most the trigrams of one frequent bigram, each once
for every ``TOKENS_HELD`` tokens. The number of shards grows with the corpus. Scoring maps the files into memory; no token
of the scored texts is shuffled.

Defined cases: a null text is the empty one (only the end token); no training rows give p = 1 for everything
(log 0); token order within a text is kept whatever its length; over 2**32 - 2 distinct tokens, or 2**63 in the product
of a shard's bigrams and the tokens, raise an error; repeated rows get equal scores; extra columns are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, local_path, new_folder, table, text_bytes

#: Estimated discounts are held between these.
DISCOUNTS = (0.1, 0.95)
#: Distinct words counted in one task before they are passed on.
WORDS_HELD = 400_000
#: Tokens whose trigrams are sorted at once, in counting and in scoring.
TOKENS_HELD, SCORED_HELD = 2_000_000, 1_000_000
#: Training tokens for each shard, about.
SHARD_TOKENS = 4_000_000
#: Trigrams merged at once.
MERGED_HELD = 8_000_000
#: Maps of files kept open in a worker.
MAPS = 512
#: The end token: no word contains a line feed.
END = b"\n"
_U = np.uint64


# Elias-Fano -----------------------------------------------------------------------------------------------


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th set bit (from 0) of each word."""
    at = np.zeros(len(words), np.int64)
    words, rank = words.copy(), rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & _U((1 << width) - 1)).astype(np.int64)
        skip = rank >= low
        rank -= np.where(skip, low, 0)
        words = np.where(skip, words >> _U(width), words)
        at += np.where(skip, width, 0)
    return at


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray  # packed low parts
    high: np.ndarray  # unary high parts
    ones: np.ndarray  # set bits before each word of ``high``

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(_U)
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = (universe >> bits) + 1
        at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(-(-(n + top) // 64) * 64, np.uint8)
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view(_U)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]))
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits and n:
            part = values & _U((1 << bits) - 1)
            place = np.arange(n, dtype=np.int64) * bits
            word, off = place >> 6, (place & 63).astype(_U)
            np.bitwise_or.at(low, word, part << off)
            spill = (off.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (_U(64) - off[spill]))
        return cls(n, bits, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        place = i * self.low_bits
        word, off = place >> 6, (place & 63).astype(_U)
        out = self.low[word] >> off
        more = off != 0
        out = out | np.where(more, self.low[word + 1] << np.where(more, _U(64) - off, _U(0)), _U(0))
        return out & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        at = (word << 6) + _select_in_word(self.high[word], i - self.ones[word])
        return ((at - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def _ends(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is at most ``high`` (-1: none)."""
        k = np.maximum(high, 0)
        zeros = self._zeros
        word = np.searchsorted(zeros, k, "right") - 1
        at = (word << 6) + _select_in_word(~self.high[word], k - zeros[word])
        return np.where(high < 0, 0, at - k)

    @property
    def _zeros(self) -> np.ndarray:
        made = self.__dict__.get("_made")
        if made is None:
            made = self.__dict__["_made"] = (np.arange(len(self.high), dtype=np.int64) << 6) - self.ones
        return made

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        values = values.astype(_U)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        want = values & _U((1 << self.low_bits) - 1)
        first, last = self._ends(high - 1), self._ends(high)
        out = np.full(len(values), -1, np.int64)
        live = np.flatnonzero(first < last)
        lo, hi = first[live], last[live]
        while len(live):
            mid = (lo + hi) >> 1
            got, need = self._low(mid), want[live]
            hit = got == need
            out[live[hit]] = mid[hit]
            less = got < need
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            go = ~hit & (lo < hi)
            live, lo, hi = live[go], lo[go], hi[go]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}


def write_file(path: str, head: dict, arrays: dict[str, np.ndarray]) -> None:
    place, spots = 0, {}
    for name, a in arrays.items():
        spots[name] = [a.dtype.str, place, len(a)]
        place += -(-a.nbytes // 64) * 64
    text = json.dumps({"head": head, "arrays": spots}).encode()
    text += b" " * (-(len(text) + 8) % 64)
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as file:
        file.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            file.write(a.tobytes() + bytes(-a.nbytes % 64))
    os.replace(aside, path)


@lru_cache(maxsize=MAPS)
def map_file(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(bytes(data[:8]), "little")
    info = json.loads(bytes(data[8 : 8 + size]))
    start = 8 + size
    arrays = {
        name: np.frombuffer(data, kind, n, start + place) if n else np.zeros(0, kind)
        for name, (kind, place, n) in info["arrays"].items()
    }
    return info["head"], arrays


@lru_cache(maxsize=8 * MAPS)
def _sequence(path: str, name: str) -> EliasFano:
    head, arrays = map_file(path)
    n, bits = head[name]
    return EliasFano(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


# Model ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the files are, and the totals; what every task needs to know."""

    folder: str
    vocab_bits: int
    offsets: list[int] = field(default_factory=list)  # first id of each token shard, then V
    tokens: int = 0
    shards: int = 0
    hot: dict[int, float] = field(default_factory=dict)  # D * children of contexts dealt by successor
    entries: tuple[int, int] = (0, 0)  # distinct bigrams and trigrams

    @property
    def types(self) -> int:
        return self.offsets[-1]

    @property
    def unit(self) -> float:
        return float(self.tokens + self.types + 1)


def _hashes(words) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))


def _vocab(model: Model, shard: int) -> tuple[EliasFano, np.ndarray]:
    path = f"{model.folder}/tokens-{shard}"
    return _sequence(path, "hash"), map_file(path)[1]["counts"]


def token_ids(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: unknown) and counts of tokens given by hash."""
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    shift = _U(64 - model.vocab_bits)
    home = (hashes >> shift).astype(np.int64)
    order = np.argsort(hashes)
    edges = np.searchsorted(home[order], np.arange((1 << model.vocab_bits) + 1))
    mask = _U((1 << (64 - model.vocab_bits)) - 1)
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        if model.offsets[shard] == model.offsets[shard + 1]:
            continue
        mine = order[edges[shard] : edges[shard + 1]]
        sequence, number = _vocab(model, shard)
        place = sequence.find(hashes[mine] & mask)
        known = place >= 0
        ids[mine[known]] = place[known] + model.offsets[shard]
        counts[mine[known]] = number[place[known]]
    return ids, counts


def counts_of(model: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of tokens given by id (rising)."""
    out = np.zeros(len(ids), np.int64)
    edges = np.searchsorted(ids, model.offsets)
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[shard], edges[shard + 1])
        out[part] = _vocab(model, shard)[1][ids[part] - model.offsets[shard]]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(_U) * _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def shard_of(model: Model, keys: np.ndarray) -> np.ndarray:
    """Shard of each (context << 32 | token): by context, or by both where the context is hot."""
    context = keys >> _U(32)
    seed = context
    if model.hot:
        hot = np.isin(context, np.array(sorted(model.hot), _U))
        seed = np.where(hot, _mixed(keys), context)
    return (_mixed(seed) % _U(model.shards)).astype(np.int64)


class Tokens:
    """Gathers texts; gives ids and counts of all their tokens, an end token after each text."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {END: 0}
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.held = 0

    def add(self, raw: bytes | None) -> None:
        place = self.place
        words = (raw or b"").lower().split()
        words.append(END)
        self.parts.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
        self.sizes.append(len(words))
        self.held += len(words)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids and counts of distinct words, the end token first; the word of each token; tokens of each text). Starts anew."""
        ids, counts = token_ids(self.model, _hashes(self.place))
        which = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        sizes = np.array(self.sizes, np.int64)
        self.clear()
        return ids, counts, which.astype(np.int64), sizes


def _before(which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each token; before a text is the end token, word 0."""
    out = np.zeros(len(which), np.int64)
    out[1:] = which[:-1]
    out[np.cumsum(sizes) - sizes] = 0
    return out


def distinct_rows(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers under ``size``, in order, and how often each occurs."""
    bits = size.bit_length()
    if bits * len(columns) <= 64:
        packed = columns[0].astype(_U)
        for c in columns[1:]:
            packed = (packed << _U(bits)) | c.astype(_U)
        packed, counts = np.unique(packed, return_counts=True)
        mask = _U((1 << bits) - 1)
        return [((packed >> _U(bits * (len(columns) - 1 - i))) & mask).astype(np.int64) for i in range(len(columns))], counts
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(order)))


# Building -------------------------------------------------------------------------------------------------


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    raw = len(keys).to_bytes(8, "little") + steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(_U).ravel()
    counts = np.frombuffer(raw, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=_U), counts.astype(np.int64)


def _merged(blobs) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpacked(b) for b in blobs]
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _packed_triples(keys: np.ndarray, following: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in (following, counts)]
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + steps.tobytes() + b"".join(planes))


def _unpacked_triples(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view(_U).ravel()
    planes = [np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view("<u4").ravel() for at in (8 + 8 * n, 8 + 12 * n)]
    return np.cumsum(steps, dtype=_U), planes[0], planes[1].astype(np.int64)


class Triples:
    """Adds up blocks of (bigram, following token + 1 or 0, count) in bounded steps."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.held = self.least = 0

    def add(self, blob: bytes) -> None:
        part = _unpacked_triples(blob)
        self.parts.append(part)
        self.held += len(part[0])
        # What is left after merging counts twice, so that a shard of many distinct trigrams isn't merged over and over.
        if self.held > max(MERGED_HELD, 2 * self.least):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, following, counts = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        distinct, place = np.unique(keys, return_inverse=True)
        # Places fit 32 bits beside the following token: one sort of whole numbers.
        packed = (place.astype(_U) << _U(32)) | following.astype(_U)
        del keys, following, place
        order = np.argsort(packed)
        packed = packed[order]
        starts = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        counts = np.add.reduceat(counts[order], starts)
        packed = packed[starts]
        out = distinct[(packed >> _U(32)).astype(np.int64)], (packed & _U(0xFFFFFFFF)).astype(np.uint32), counts
        self.parts, self.held, self.least = [out], len(counts), len(counts)
        return out


_BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.binary())])


def _blocks(shards: np.ndarray, pack, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted columns, dealt by shard and packed."""
    if not len(shards):
        return
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(shards[order]) != 0, [True])))
    home, out = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        mine = order[a:b]
        home.append(int(shards[mine[0]]))
        out.append(pack(*(c[mine] for c in columns)))
    yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(out, pa.binary())], schema=_BLOCKS)


def _count_tokens(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush():
            hashes = _hashes(held)
            counts = np.fromiter(held.values(), np.int64, len(held))
            order = np.argsort(hashes)
            held.clear()
            yield from _blocks((hashes[order] >> _U(64 - bits)).astype(np.int64), _packed, hashes[order], counts[order])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.update((raw or b"").lower().split())
                held[END] += 1
                if len(held) > WORDS_HELD:
                    yield from flush()
        yield from flush()

    return run


def _count_triples(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model)

        def flush():
            ids, _, which, sizes = tokens.take()
            # Words numbered in the order of their ids, so that blocks are sorted by id.
            order = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            following = np.zeros(len(which), np.int64)
            following[:-1] = rank[which[1:]] + 1
            following[np.cumsum(sizes) - 1] = 0
            (first, second, third), counts = distinct_rows([rank[_before(which, sizes)], rank[which], following], len(ids) + 1)
            ids = ids[order].astype(_U)
            keys = (ids[first] << _U(32)) | ids[second]
            third = np.where(third > 0, ids[np.maximum(third, 1) - 1] + _U(1), _U(0))
            yield from _blocks(shard_of(model, keys), _packed_triples, keys, third, counts)

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                tokens.add(raw)
                if tokens.held > TOKENS_HELD:
                    yield from flush()
        if tokens.held:
            yield from flush()

    return run


def _build_tokens(folder: str, bits: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        hashes, counts = _merged(group["block"])
        sequence = EliasFano.build(hashes & _U((1 << (64 - bits)) - 1), 1 << (64 - bits))
        kind = np.uint32 if counts.max() < 1 << 32 else np.int64
        os.makedirs(folder, exist_ok=True)
        write_file(
            f"{folder}/tokens-{shard}",
            {"hash": [sequence.n, sequence.low_bits]},
            sequence.arrays("hash") | {"counts": counts.astype(kind)},
        )
        top = np.argsort(-counts)[:256]
        return pd.DataFrame({"shard": [shard], "n": [len(counts)], "tokens": [int(counts.sum())], "top": [top.tolist()], "top_n": [counts[top].tolist()]})

    return run


def _quantised(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each logarithm, and the number each byte stands for: the mean of its bin."""
    if not len(log):
        return np.zeros(0, np.uint8), np.ones(256)
    low, high = float(log.min()), float(log.max())
    code = np.rint((log - low) * (255 / (high - low or 1.0))).astype(np.uint8)
    weight = np.bincount(code, minlength=256)
    return code, 10.0 ** (np.bincount(code, log, 256) / np.maximum(weight, 1))


def _discount(counts: np.ndarray, given: float | None) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return given if given is not None else min(max(n1 / max(1, n1 + 2 * n2), DISCOUNTS[0]), DISCOUNTS[1])


def _write_shard(model: Model, shard: int, triples: Triples, discount: float | None) -> dict:
    keys, following, counts = triples.merged()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    pair_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    pairs, pair_counts = keys[first], np.add.reduceat(counts, first)
    types = max(1, model.types)
    if len(pairs) * types >= 1 << 63:
        raise ValueError(f"{len(pairs)} bigrams in a shard are too many beside {types} tokens: use smaller shards")
    # Level 2.
    d2 = _discount(pair_counts, discount)
    context = (pairs >> _U(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    contexts, children = context[starts], np.diff(np.append(starts, len(pairs)))
    place = np.repeat(np.arange(len(contexts)), children).astype(_U)
    total = np.repeat(counts_of(model, contexts), children)
    # Level 3: what follows a bigram; only the end token is followed by nothing.
    real = following > 0
    pair_of, counts, following = pair_of[real], counts[real], following[real].astype(_U) - _U(1)
    d3 = _discount(counts, discount)
    grandchildren = np.bincount(pair_of, minlength=len(pairs))
    code2, book2 = _quantised(np.log10((pair_counts - d2) / total))
    code3, book3 = _quantised(np.log10((counts - d3) / pair_counts[pair_of]))
    mass, mass_book = _quantised(np.log10(d3 * np.maximum(grandchildren, 1) / pair_counts))
    sequences = {
        "roots": EliasFano.build(contexts, types),
        "pointers": EliasFano.build(np.append(starts, len(pairs)), len(pairs) + 1),
        "successors": EliasFano.build(place * _U(types) + (pairs & _U(0xFFFFFFFF)), max(1, len(contexts) * types)),
        "pointers3": EliasFano.build(np.concatenate(([0], np.cumsum(grandchildren))), len(pair_of) + 1),
        "successors3": EliasFano.build(pair_of.astype(_U) * _U(types) + following, max(1, len(pairs) * types)),
    }
    arrays = {"code": code2, "book": book2, "mass": mass, "mass_book": mass_book, "code3": code3, "book3": book3}
    for name, sequence in sequences.items():
        arrays |= sequence.arrays(name)
    write_file(f"{model.folder}/shard-{shard}", {"discount": d2} | {k: [q.n, q.low_bits] for k, q in sequences.items()}, arrays)
    hot = np.isin(contexts, sorted(model.hot))
    return {"shard": shard, "pairs": len(pairs), "triples": len(pair_of), "hot": contexts[hot].tolist(), "mass": (d2 * children[hot]).tolist()}


_WRITTEN = pa.schema(
    [("shard", pa.int32()), ("pairs", pa.int64()), ("triples", pa.int64()), ("hot", pa.list_(pa.int64())), ("mass", pa.list_(pa.float64()))]
)


def _build_shards(model: Model, discount: float | None):
    """Over blocks sorted by shard: one file for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, triples = None, Triples()
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held is not None and shard != held:
                    yield pa.RecordBatch.from_pylist([_write_shard(model, held, triples, discount)], schema=_WRITTEN)
                    triples = Triples()
                held = shard
                triples.add(block.as_py())
        if held is not None:
            yield pa.RecordBatch.from_pylist([_write_shard(model, held, triples, discount)], schema=_WRITTEN)

    return run


def train(texts: DataFrame, folder: str, text_col: str = "text", discount: float | None = None, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count, build and write the model of the rows of ``texts`` to ``folder`` (a mounted path)."""
    data = texts.select(text_bytes(text_col).alias("text"))
    bits = max(2, math.ceil(math.log2(max(1, data.rdd.getNumPartitions()))) - 1)
    blocks = data.mapInArrow(_count_tokens(bits), "shard int, block binary")
    rows = blocks.repartition(1 << bits, "shard").groupBy("shard").applyInPandas(
        _build_tokens(folder, bits), "shard int, n long, tokens long, top array<long>, top_n array<long>"
    )
    found = {r.shard: r for r in rows.collect()}
    model = Model(folder, bits, [0])
    for shard in range(1 << bits):
        r = found.get(shard)
        model.offsets.append(model.offsets[-1] + (r.n if r else 0))
        model.tokens += r.tokens if r else 0
    if model.types > (1 << 32) - 2:
        raise ValueError(f"{model.types} distinct tokens: ids have 32 bits")
    model.shards = max(1, math.ceil(model.tokens / shard_tokens))
    # A context over a quarter of a shard's share is dealt by successor: fewer than 4 contexts a shard.
    for shard, r in found.items():
        for at, n in zip(r.top, r.top_n):
            if n > shard_tokens / 4:
                model.hot[model.offsets[shard] + at] = 0
    if model.tokens:
        blocks = data.mapInArrow(_count_triples(model), "shard int, block binary")
        sorted_ = blocks.repartitionById(model.shards, F.col("shard")).sortWithinPartitions("shard")
        rows = sorted_.mapInArrow(_build_shards(model, discount), "shard int, pairs long, triples long, hot array<long>, mass array<double>")
        mass: Counter[int] = Counter()
        for r in rows.collect():
            mass.update(dict(zip(r.hot, r.mass)))
            model.entries = (model.entries[0] + r.pairs, model.entries[1] + r.triples)
        model.hot = {h: float(mass[h]) for h in model.hot}
    return model


# Scoring --------------------------------------------------------------------------------------------------


@dataclass
class Pairs:
    """What the model knows of distinct bigrams (context << 32 | token, rising)."""

    seen: np.ndarray  # discounted probability (0: unseen)
    context_mass: np.ndarray  # D * children of the context
    home: np.ndarray  # shard
    place: np.ndarray  # place in the shard's level 2, -1: unseen
    mass: np.ndarray  # back-off mass as a context (1: no part of its own)


def look_up(model: Model, keys: np.ndarray) -> Pairs:
    n = len(keys)
    out = Pairs(np.zeros(n), np.zeros(n), shard_of(model, keys), np.full(n, -1, np.int64), np.ones(n))
    types = _U(max(1, model.types))
    for shard, mine in _by_shard(out.home, model.shards):
        path = f"{model.folder}/shard-{shard}"
        if not os.path.exists(path):
            continue
        context = keys[mine] >> _U(32)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        place = _sequence(path, "roots").find(context[first])
        has = place >= 0
        number = np.zeros(len(first))
        number[has] = _mass(path, place[has])
        spread = np.diff(np.append(first, len(mine)))
        place = np.repeat(place, spread)
        out.context_mass[mine] = np.repeat(number, spread)
        has = place >= 0
        mine, place = mine[has], place[has]
        at = _sequence(path, "successors").find(place.astype(_U) * types + (keys[mine] & _U(0xFFFFFFFF)))
        hit = at >= 0
        arrays = map_file(path)[1]
        mine, at = mine[hit], at[hit]
        out.seen[mine] = arrays["book"][arrays["code"][at]]
        out.place[mine] = at
        out.mass[mine] = arrays["mass_book"][arrays["mass"][at]]
    for context, mass in model.hot.items():
        a, b = np.searchsorted(keys, (_U(context << 32), _U((context + 1) << 32)))
        out.context_mass[a:b] = mass
    return out


def _by_shard(home: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(shards + 1))
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        yield shard, order[edges[shard] : edges[shard + 1]]


def look_up_third(model: Model, pairs: Pairs, at: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Discounted probabilities of tokens after known bigrams (0: unseen): a successor search relative to the bigram's place."""
    out = np.zeros(len(at))
    types = _U(max(1, model.types))
    for shard, mine in _by_shard(pairs.home[at], model.shards):
        path = f"{model.folder}/shard-{shard}"
        found = _sequence(path, "successors3").find(pairs.place[at[mine]].astype(_U) * types + token[mine].astype(_U))
        hit = found >= 0
        arrays = map_file(path)[1]
        out[mine[hit]] = arrays["book3"][arrays["code3"][found[hit]]]
    return out


def _mass(path: str, place: np.ndarray) -> np.ndarray:
    """D * children of contexts given by place: a difference of two pointers."""
    pointers = _sequence(path, "pointers")
    return map_file(path)[0]["discount"] * (pointers.get(place + 1) - pointers.get(place)).astype(float)


def score_texts(model: Model, tokens: Tokens, order: int = 3):
    """(n_tokens, n_known, base, score) of the texts gathered in ``tokens``."""
    ids, counts, which, sizes = tokens.take()
    starts = np.cumsum(sizes) - sizes
    word_base = (counts + 1) / model.unit
    before = _before(which, sizes)
    base = word_base[which]
    p = base.copy()
    known = (ids[before] >= 0) & (ids[which] >= 0)
    if model.tokens and known.any():
        bits = len(ids).bit_length()
        packed, inverse = np.unique((before[known] << bits) | which[known], return_inverse=True)
        first, second = packed >> bits, packed & ((1 << bits) - 1)
        keys = (ids[first].astype(_U) << _U(32)) | ids[second].astype(_U)
        by_key = np.argsort(keys)
        pairs = look_up(model, keys[by_key])
        rank = np.empty(len(keys), np.int64)
        rank[by_key] = np.arange(len(keys))
        pair_at = np.full(len(which), -1, np.int64)
        pair_at[known] = rank[inverse]
        mine = pair_at[known]
        p[known] = pairs.seen[mine] + pairs.context_mass[mine] / counts[before[known]] * base[known]
    # Known context, unknown token: only the back-off part.
    rest = ~known & (counts[before] > 0)
    if model.tokens and rest.any():
        distinct, inverse = np.unique(ids[before[rest]].astype(_U) << _U(32), return_inverse=True)
        p[rest] = mass_of(model, distinct)[inverse] / counts[before[rest]] * base[rest]
    if order > 2 and model.tokens and known.any():
        # The context of a token is the bigram that ends before it.
        context = np.full(len(which), -1, np.int64)
        context[1:] = pair_at[:-1]
        context[starts] = -1
        has = context >= 0
        has[has] = pairs.place[context[has]] >= 0
        at = np.flatnonzero(has)
        p[at] *= pairs.mass[context[at]]
        at = at[ids[which[at]] >= 0]
        packed, inverse = np.unique((context[at] << bits) | which[at], return_inverse=True)
        third = look_up_third(model, pairs, packed >> bits, ids[packed & ((1 << bits) - 1)])
        p[at] += third[inverse]
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
    return sizes, add((counts[which] > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p))


def mass_of(model: Model, keys: np.ndarray) -> np.ndarray:
    """D * children of contexts given as context << 32 (distinct, rising)."""
    context = keys >> _U(32)
    out = np.zeros(len(keys))
    home = (_mixed(context) % _U(model.shards)).astype(np.int64)
    for shard in np.unique(home).tolist():
        path = f"{model.folder}/shard-{shard}"
        if os.path.exists(path):
            mine = np.flatnonzero(home == shard)
            place = _sequence(path, "roots").find(context[mine])
            mine, place = mine[place >= 0], place[place >= 0]
            out[mine] = _mass(path, place)
    for hot, n in model.hot.items():
        out[context == _U(hot)] = n
    return out


def score(df: DataFrame, model: Model, keep: list[Column], text_col: str = "text", order: int = 3) -> DataFrame:
    """The columns in ``keep``, then n_tokens, n_known, train_tokens, base_score, score for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    data = df.select(*keep, text_bytes(text_col).alias("__lx_text"))
    kept = data.schema.fields[:-1]
    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens long, n_known long, train_tokens long, base_score double, score double"]
    )
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model)
        for batch in batches:
            texts = batch.column(len(kept))
            start = 0
            for i in range(len(texts)):
                tokens.add(texts[i].as_py())
                if tokens.held > SCORED_HELD or i == len(texts) - 1:
                    sizes, known, base, total = score_texts(model, tokens, order)
                    part = [c.slice(start, i + 1 - start) for c in batch.columns[: len(kept)]]
                    columns = [sizes, known, np.full(len(sizes), model.tokens), base, total]
                    yield pa.RecordBatch.from_arrays(part + [pa.array(c) for c in columns], schema=arrow)
                    start = i + 1

    return data.mapInArrow(run, schema)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents outside the held-out fold; score all of them."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_fold("doc_id", 7) != 2), local_path(new_folder(spark, "lm")))
    return score(docs, model, [F.col("doc_id"), (crc_fold("doc_id", 7) == 2).alias("held_out")])
