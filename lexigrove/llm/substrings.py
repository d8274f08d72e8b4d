"""Substring deduplication: super-k-mers dealt by their minimiser, windows counted by sorting.

A window is ``K`` consecutive words of a text. Its minimiser is the least hash of its ``M``-word parts; consecutive windows
with the same minimiser form a super-k-mer and travel together as one string of words to the minimiser's bucket, so a word is
sent about three times instead of ``K`` times. Equal windows have equal minimisers, so all strings that hold a window
meet in one bucket. There the windows of all strings are hashed, sorted and compared byte by byte, and each gets its owner: the
least document id in which it starts. A string whose windows are partly owned by a document before one of its holders is
reported with its owners, and the documents that hold the string look them up (by a 128-bit digest of the string).

Strings are combined before they are sent (least and greatest id of their holders), so a passage in a third of all
documents costs one row a task. A frequent minimiser in ever new contexts (the edge of a common passage, a
common phrase) would make its bucket hot: minimisers of over ``1 / HOT`` of the strings of a sample of ``SAMPLE_DOCS``
documents are hot, and their windows travel one by one, dealt by their own hash. The sample decides where windows
meet, never what is found: a bucket that still exceeds ``OVERFULL`` times its size reports its frequent minimisers (or asks for more
buckets), and the dealing is done again with these. Each bucket is sorted in one task's memory, at most ``OVERFULL * BUCKET_BYTES``.

Defined cases: a null text has no words; texts under ``K`` words lose nothing; a null id comes after all others, and null ids
don't precede each other (nor do equal ids); repeated rows are judged alike; extra columns are never looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_rows, release, saved, table, text_bytes

K, M = 13, 4
#: Bytes of strings in a bucket, about, and how many times as many make it overfull.
BUCKET_BYTES, OVERFULL = 16 << 20, 4
#: Bound of the sample that finds hot minimisers; one part in HOT of its strings makes a minimiser hot.
SAMPLE_DOCS, HOT = 20_000, 5_000
#: Bytes of combined strings (with what Python adds) that a task holds before it sends them, and words that it cuts at once.
HELD_BYTES, PIECE_WORDS = 96 << 20, 1 << 16
NO_ID = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up, cls.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_ODD, _ODD_INVERSE))
        return cls.up, cls.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slices(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial in the bytes, and the inverse powers that bring a slice to its start."""
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def cut(words: list[bytes], hot: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Super-k-mers of a text, piece by piece: (words joined by spaces, first byte and end of each super-k-mer, its first
    word in the text, and the key that deals it). Windows of hot minimisers are cut one by one."""
    for base in range(0, len(words) - K + 1, PIECE_WORDS):
        part = words[base : base + PIECE_WORDS + K - 1]
        line = b" ".join(part)
        sums, down = _slices(line)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))

        def hashed(n: int, sums=sums, down=down, starts=starts, ends=ends) -> np.ndarray:
            first = starts[: len(starts) - n + 1]
            return _mixed((sums[ends[n - 1 :]] - sums[first]) * down[first])

        key = _least(hashed(M), K - M + 1)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        if len(hot):
            alone = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            if alone.any():
                new |= alone
                new[1:] |= alone[:-1]
                key = np.where(alone, hashed(K), key)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        yield line, starts[first], ends[last + K - 1], base + first, key[first]


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.binary())])


def _packed(strings: dict[bytes, int], greatest: dict[bytes, int]) -> bytes:
    import zstandard

    low = np.fromiter(strings.values(), np.int64, len(strings))
    high = np.fromiter(map(greatest.get, strings, strings.values()), np.int64, len(strings))
    lengths = np.fromiter(map(len, strings), np.uint32, len(strings))
    head = np.array([len(strings)], np.int64).tobytes()
    # Ids come in the order of the rows: their steps are small.
    body = head + lengths.tobytes() + np.diff(low, prepend=0).tobytes() + (high - low).tobytes() + b"".join(strings)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(lengths, least ids, greatest ids, joined strings)."""
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    lengths = np.frombuffer(body, np.uint32, n, 8).astype(np.int64)
    low = np.cumsum(np.frombuffer(body, np.int64, n, 8 + 4 * n))
    return lengths, low, low + np.frombuffer(body, np.int64, n, 8 + 12 * n), body[8 + 20 * n :]


def _dealt(parts: int, hot: np.ndarray):
    """Over rows (id, text): combined strings of each part as compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Least ids of the strings of each part, and greatest ones where they differ.
        held: list[dict[bytes, int]] = [{} for _ in range(parts)]
        greatest: dict[bytes, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, strings in enumerate(held):
                if strings:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(strings, greatest)], pa.binary())], schema=_BLOCKS)
                    held[part] = {}
            greatest.clear()

        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                own = row.as_py()
                for line, starts, ends, _, keys in cut((text.as_py() or b"").split(), hot):
                    places = (keys % np.uint64(parts)).tolist()
                    for a, b, part in zip(starts.tolist(), ends.tolist(), places):
                        string = line[a:b]
                        least = held[part].setdefault(string, own)
                        if least != own:
                            if own < least:
                                held[part][string] = own
                                greatest.setdefault(string, least)
                            elif own > greatest.get(string, least):
                                greatest[string] = own
                    # Repeats count as well: about what the strings take, with what Python adds.
                    size += int((ends - starts).sum()) + 150 * len(starts)
                    if size > HELD_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _owners(low: np.ndarray, high: np.ndarray, lengths: np.ndarray, text: bytes) -> Iterator[tuple[bytes, np.ndarray]]:
    """(string, owner of each of its windows) for each string with a window that starts in an earlier document
    than one of the string's holders. Windows are sorted by hash, and equal hashes are compared byte by byte."""
    stops = np.cumsum(lengths)
    begins = stops - lengths
    hashes, of, starts, ends = [], [], [], []
    # As many strings at once as make some megabytes: hashing takes 24 bytes for each of theirs.
    for a in range(0, len(lengths), 1 << 13):
        b = min(len(lengths), a + (1 << 13))
        base = int(begins[a])
        raw = text[base : int(stops[b - 1])]
        sums, down = _slices(raw)
        data = np.frombuffer(raw, np.uint8)
        # Words of all strings: a string starts one, and so does each space.
        opens = np.zeros(len(raw), bool)
        opens[1:] = data[:-1] == 32
        opens[begins[a:b] - base] = True
        word = np.flatnonzero(opens)
        close = np.empty(len(word), np.int64)
        close[:-1] = word[1:] - 1
        close[-1] = len(raw)
        string = np.searchsorted(begins[a:b] - base, word, "right") - 1
        last = np.append(string[1:] != string[:-1], True)
        close[last] = (stops[a:b] - base)[string[last]]
        window = np.flatnonzero(string[: len(word) - K + 1] == string[K - 1 :]) if len(word) >= K else np.zeros(0, np.int64)
        first, end = word[window], close[window + K - 1]
        hashes.append(_mixed((sums[end] - sums[first]) * down[first]))
        of.append(string[window] + a)
        starts.append(first + base)
        ends.append(end + base)
    h, of, starts, ends = map(np.concatenate, (hashes, of, starts, ends))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    # Equal hashes of different windows (once in a great while): their run is sorted by the windows themselves.
    wrong = _unlike(text, starts[order[:-1][same]], starts[order[1:][same]], ends[order[:-1][same]], ends[order[1:][same]])
    if wrong.any():
        at = np.flatnonzero(same)
        for x in np.unique(h[order[at[wrong]]]):
            a, b = np.searchsorted(h[order], x), np.searchsorted(h[order], x, "right")
            order[a:b] = sorted(order[a:b].tolist(), key=lambda i: text[starts[i] : ends[i]])
            for j in range(a, b - 1):
                same[j] = text[starts[order[j]] : ends[order[j]]] == text[starts[order[j + 1]] : ends[order[j + 1]]]
    run = np.cumsum(np.concatenate(([0], ~same)))
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    owner = np.empty(len(h), np.int64)
    owner[order] = np.minimum.reduceat(low[of[order]], heads)[run]
    tell = np.zeros(len(lengths), bool)
    tell[of[owner < high[of]]] = True
    edges = np.searchsorted(of, np.arange(len(lengths) + 1))
    for s in np.flatnonzero(tell).tolist():
        yield text[begins[s] : stops[s]], owner[edges[s] : edges[s + 1]]


def _unlike(text: bytes, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Which pairs of slices differ."""
    out = a_end - a != b_end - b
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(a), 1 << 14):
        n = np.where(out[at : at + (1 << 14)], 0, (a_end - a)[at : at + (1 << 14)])
        if not n.sum():
            continue
        pair = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        differs = data[a[at + pair] + within] != data[b[at + pair] + within]
        out[at + np.unique(pair[differs])] = True
    return out


def _digests(strings: list[bytes]) -> np.ndarray:
    """Two longs for each string."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


_FOUND = "over long, h1 long, h2 long, owners binary"


def _counted(limit: int):
    """Over blocks sorted by part: strings with owners; of an overfull part its frequent minimisers, or 0 for none such."""
    arrow = pa.schema([("over", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("owners", pa.binary())])

    def rows(strings: list[bytes], owners: list[np.ndarray]) -> pa.RecordBatch:
        d = _digests(strings)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(len(d), pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([o.tobytes() for o in owners], pa.binary())],
            schema=arrow,
        )

    def judged(blocks: list) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        if not blocks:
            return
        lengths, low, high = (np.concatenate([b[i] for b in blocks]) for i in range(3))
        text = b"".join(b[3] for b in blocks)
        blocks.clear()
        strings, owners, told = [], [], set()
        for s, o in _owners(low, high, lengths, text):
            # Tasks (and flushes of one) send a string each; its windows have the same owners in all copies.
            d = xxh3_128_digest(s)
            if d in told:
                continue
            told.add(d)
            strings.append(s)
            owners.append(o)
            if len(strings) == 1 << 15:
                yield rows(strings, owners)
                strings, owners = [], []
        if strings:
            yield rows(strings, owners)

    def frequent(counts: dict[int, int], total: int) -> pa.RecordBatch:
        found = [k for k, n in counts.items() if n * 64 >= total] or [0]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(found, np.uint64).view(np.int64)), *(pa.nulls(len(found), t) for t in arrow.types[1:])], schema=arrow
        )

    def weigh(block, counts: dict[int, int]) -> int:
        lengths, _, _, text = block
        stops = np.cumsum(lengths).tolist()
        for a, b in zip([0, *stops], stops):
            for _, _, _, _, keys in cut(text[a:b].split(), np.zeros(0, np.uint64)):
                counts[int(keys[0])] = counts.get(int(keys[0]), 0) + b - a
        if len(counts) > 1 << 20:  # what is rare can't come to a 64th
            for k in sorted(counts, key=counts.get)[: len(counts) - (1 << 14)]:
                del counts[k]
        return len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, size, counts = None, [], 0, {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if size > limit:
                        yield frequent(counts, size)
                    yield from judged(blocks)
                    part, size, counts = p, 0, {}
                block = _unpacked(raw.as_py())
                if size <= limit:
                    size += len(block[3])
                    blocks.append(block)
                    if size > limit:
                        size = sum(weigh(b, counts) for b in blocks) + limit
                        blocks.clear()
                else:
                    size += weigh(block, counts)
        if size > limit:
            yield frequent(counts, size)
        yield from judged(blocks)

    return run


def _hot_minimisers(docs: DataFrame, rows: int, sample_docs: int, hot: int) -> np.ndarray:
    """Minimisers of over one part in ``hot`` of the strings of a sample chosen by hash."""
    none = np.zeros(0, np.uint64)
    drawn = docs if rows <= sample_docs else docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < (sample_docs << 20) // rows)

    def run(texts):
        keys, strings = [], []
        for t in texts:
            for line, starts, ends, _, key in cut((t or b"").split(), none):
                keys += key.view(np.int64).tolist()
                strings += _digests([line[a:b] for a, b in zip(starts.tolist(), ends.tolist())])[:, 0].tolist()
        return keys, strings

    seen = over_rows(drawn.select("text"), run, "key long, string long").distinct().groupBy("key").count()
    seen = saved(seen, "minimisers")
    total = seen.agg(F.sum("count")).first()[0] or 0
    # Fewer than ``hot`` of them, by their definition.
    found = seen.where(F.col("count") > max(total // hot, 100)).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def _windows(docs: DataFrame, parts: int, hot: np.ndarray, bucket_bytes: int) -> DataFrame:
    blocks = docs.select("id", "text").mapInArrow(_dealt(parts, hot), "part int, block binary")
    # Blocks are sorted by part, as a task may get several.
    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_counted(OVERFULL * bucket_bytes), _FOUND)


def repeated_strings(
    docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, sample_docs: int = SAMPLE_DOCS, hot_share: int = HOT
) -> tuple[DataFrame, np.ndarray]:
    """From (id, text): a row (h1, h2, owners) for each distinct string partly owned by an earlier document, and the hot minimisers
    with which texts must be cut to meet them. Owners are one 64-bit number a window."""
    rows, size = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    hot = _hot_minimisers(docs, rows, sample_docs, hot_share)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-3 * (size or 0) // bucket_bytes))
    while True:
        found = saved(_windows(docs, parts, hot, bucket_bytes), "windows")
        release(docs.sparkSession)
        over = [r.over for r in found.where("over is not null").select("over").distinct().collect()]
        if not over:
            return found.select("h1", "h2", "owners"), hot
        more = np.setdiff1d(np.array([x for x in over if x], np.int64).view(np.uint64), hot)
        if len(more):
            hot = np.union1d(hot, more)
        else:
            parts *= 2


def _own(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_bytes(text_col).alias("text")]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Rows (id, n_words, n_removed, kept): the text's words without those that earlier documents have in a window of
    ``K`` words, joined by spaces, as UTF-8 bytes."""
    flat = docs.select(*_own(docs, id_col, text_col))
    found, hot = repeated_strings(flat, **sizes)
    by_row = F.xxhash64("id", "text")

    def strings(ids, texts):
        out_ids, digests = [], []
        for own, text in zip(ids, texts):
            mine = {line[a:b] for line, starts, ends, _, _ in cut((text or b"").split(), hot) for a, b in zip(starts.tolist(), ends.tolist())}
            if mine:
                out_ids.append(np.full(len(mine), own, np.int64))
                digests.append(_digests(list(mine)))
        if not out_ids:
            return [], [], []
        both = np.concatenate(digests)
        return np.concatenate(out_ids), both[:, 0], both[:, 1]

    # The key of a row is a hash of its id and text; rows that share one look up more strings than theirs, no others.
    holders = over_rows(flat.select(by_row.alias("row"), "text"), strings, "row long, h1 long, h2 long")
    looked_up = holders.join(found, ["h1", "h2"]).groupBy("row").agg(F.collect_set(F.struct("h1", "h2", "owners")).alias("found"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), *_own(docs, id_col, text_col)).withColumn("row", by_row)
    joined = rows.join(looked_up, "row", "left").select("doc", "id", "text", "found")

    def kept(docs_, ids, texts, founds):
        n_words, n_removed, out = [], [], []
        for own, text, found_ in zip(ids, texts, founds):
            words = (text or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            if found_:
                owners_of = {(f["h1"], f["h2"]): np.frombuffer(f["owners"], np.int64) for f in found_}
                taken = []
                for line, starts, ends, firsts, _ in cut(words, hot):
                    for (h1, h2), first in zip(_digests([line[a:b] for a, b in zip(starts.tolist(), ends.tolist())]).tolist(), firsts.tolist()):
                        owners = owners_of.get((h1, h2))
                        if owners is not None:
                            taken.append(first + np.flatnonzero(owners < own))
                if taken:
                    at = np.concatenate(taken)
                    gone += np.bincount(at, minlength=len(gone)) - np.bincount(at + K, minlength=len(gone))
            stays = np.cumsum(gone)[: len(words)] == 0
            n_words.append(len(words))
            n_removed.append(len(words) - int(stays.sum()))
            out.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s))
        return docs_, n_words, n_removed, out

    return over_rows(joined, kept, f"`{id_col}` {kind}, n_words long, n_removed long, kept binary")


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document when windows that earlier documents hold are removed."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
