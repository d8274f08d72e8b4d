"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints have 64 bits. Cut into m blocks, two fingerprints that differ in at most d bits agree on at least
m - d whole blocks; so every pair within d bits meets in a bucket keyed by some choice of m - d blocks, and
no pair is lost. m grows with the number of distinct fingerprints (a bucket should hold about one of them by
chance), which keeps the candidates near the number of fingerprints at every size. Candidates are verified
by Hamming distance.

Equal fingerprints are one node, so exact copies never meet in a bucket. Rows of a bucket arrive sorted and
are read as a stream; a bucket gives a spanning forest of its links, not all its pairs: a breadth-first
search removes what it reaches, so a dense group costs little more than its size. Buckets over
``bucket_rows`` fingerprints are not held: their members are dealt in chunks, and each pair of chunks gives its
forest (an exact way whose memory is bounded by two chunks).

The number of masks grows slowly with the number of distinct fingerprints: 5 up to about 7000, 35 near a million (m = 7),
some 210 near 1e11. Fingerprints of more than a thousandth of all rows (copies of one text, empty texts) are joined to
their components as a broadcast table of a thousand rows at most, so no task gets them all.

Defined cases: a null text has no words; no words give fingerprint 0, linked like any other; fewer words than
a shingle give one shingle; equal rows share a component; a component of null ids only has a null id; extra
columns are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_text, free_names, over_rows, saved, table, text_bytes
from .components import components

BITS = 4
SHINGLE = 4
BUCKET_ROWS = 20_000
_PAIRWISE = 8


def fingerprint(raw: bytes | None, size: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned SimHash over XXH64 of the word shingles (A-Z lower-cased, repeats included)."""
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""

    def run(keys, texts):
        return keys, [_signed(fingerprint(t)) for t in texts]

    kind = df.schema[id_col].dataType.simpleString()
    return over_rows(df.select(F.col(id_col), text_bytes(text_col).alias("text")), run, f"`{id_col}` {kind}, fp long")


def block_masks(distinct: int, bits: int) -> list[int]:
    """One mask for each choice of the blocks that must agree; as few blocks as the number of rows allows."""
    m = bits + 1
    while m < 64 and distinct > 2 ** (64 * (m - bits) / m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, m - bits)]


def distance(a: np.ndarray, b) -> np.ndarray:
    # numpy counts the bits of the absolute value of signed numbers
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(least, member) pairs that connect what is linked among distinct fingerprints."""
    left, out = np.unique(members), []
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = distance(left, queue.pop()) <= bits
            if near.any():
                reached = left[near]
                left = left[~near]
                queue.extend(reached)
                out.extend((root, r) for r in reached)
    return out


_EDGES = pa.schema([("over", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _edges(over: list, a: list, b: list) -> pa.RecordBatch:
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(join(over, bool)), pa.array(join(a, np.int64)), pa.array(join(b, np.int64))], schema=_EDGES
    )


def _bucket_links(bits: int, limit: int):
    """Over rows (key, fp) sorted by key: edges within each bucket; members of overfull buckets are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, np.zeros(0, np.int64), False
        for batch in batches:
            keys, fps = (np.asarray(c) for c in batch.columns)
            if not len(keys):
                continue
            out: tuple[list, list, list] = ([], [], [])

            def emit(flag, a, b):
                for column, values in zip(out, (np.full(len(a), flag), a, b)):
                    column.append(values)

            if held_key is not None and keys[0] == held_key:
                if over:
                    stop = int(np.searchsorted(keys, held_key, "right"))
                    emit(True, keys[:stop], fps[:stop])
                    keys, fps = keys[stop:], fps[stop:]
                    if not len(keys):
                        yield _edges(*out)
                        continue
                    held_key, held, over = None, held[:0], False
                else:
                    keys = np.concatenate((np.full(len(held), held_key, np.int64), keys))
                    fps = np.concatenate((held, fps))
            elif len(held):
                _link(np.full(len(held), held_key, np.int64), held, bits, emit)
            last = int(np.searchsorted(keys, keys[-1]))
            _link(keys[:last], fps[:last], bits, emit)
            held_key, held, over = keys[-1], fps[last:], False
            if len(held) > limit:
                emit(True, np.full(len(held), held_key, np.int64), held)
                held, over = held[:0], True
            yield _edges(*out)
        if len(held):
            out = ([], [], [])

            def emit(flag, a, b):
                for column, values in zip(out, (np.full(len(a), flag), a, b)):
                    column.append(values)

            _link(np.full(len(held), held_key, np.int64), held, bits, emit)
            yield _edges(*out)

    return run


def _link(keys: np.ndarray, fps: np.ndarray, bits: int, emit) -> None:
    """Whole buckets, sorted by key: small ones pair by pair in numpy, larger ones as a forest."""
    if len(keys) < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= _PAIRWISE, sizes)
    for shift in range(1, min(_PAIRWISE, int(sizes.max()))):
        same = (keys[shift:] == keys[:-shift]) & small[shift:]
        a, b = fps[:-shift][same], fps[shift:][same]
        near = distance(a, b) <= bits
        emit(False, a[near], b[near])
    for at, size in zip(starts[sizes > _PAIRWISE], sizes[sizes > _PAIRWISE]):
        if pairs := forest(fps[at : at + size], bits):
            a, b = np.array(pairs, np.int64).T
            emit(False, a, b)


def links(distinct: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """From distinct fingerprints (fp): pairs (a, b) that connect everything linked at ``bits`` or fewer."""
    masks = block_masks(distinct.count(), bits)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    dealt = distinct.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    found = saved(dealt.mapInArrow(_bucket_links(bits, bucket_rows), "over boolean, a long, b long"), "links")
    edges = found.where("not over").select("a", "b").distinct()
    big = found.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not big.take(1):
        return edges
    half = max(1, bucket_rows // 2)
    sizes = big.groupBy("key").agg(F.ceil(F.count("*") / F.lit(half)).cast("int").alias("chunks"))
    placed = big.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("fp", F.lit("chunk")), "chunks").cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = pairs.select(
        F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp"
    )
    again = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(
        _bucket_links(bits, 1 << 62), "over boolean, a long, b long"
    )
    return edges.union(again.select("a", "b").distinct())


#: Fingerprints of more than this part of all rows are joined by broadcast.
HOT = 1000


def _rooted(prints: DataFrame, id_col: str, bits: int, bucket_rows: int) -> DataFrame:
    """For each fingerprint of rows (id, fp): (fp, root of its component, its least id, its number of rows)."""
    first = saved(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("rows")), "distinct")
    roots = components(links(first.select("fp"), bits, bucket_rows))
    # Fingerprints without a link are their own root.
    return first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "rows")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Rows (id, fp, component_id): the least id reachable over links of at most ``bits`` differing bits."""
    prints = saved(fingerprints(df, id_col, text_col), "fingerprints")
    owned = _rooted(prints, id_col, bits, bucket_rows)
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(owned.join(least, "root").select("fp", "rows", "component_id"), "named")
    # At most HOT of them, by their definition.
    all_rows = prints.count()
    hot = F.broadcast(named.where(F.col("rows") * HOT > all_rows).select("fp", "component_id"))
    cold = named.where(F.col("rows") * HOT <= all_rows).select("fp", "component_id")
    out = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(cold, "fp"))
    return out.select(id_col, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each component: the one with its least id, then fingerprint (of equal rows, one; null ids come last).

    Rows are written once with their fingerprints; the ids and fingerprints that stay are found from those two columns, and
    texts are dealt once, to be matched with them. An empty table stays empty; columns of any name are kept.
    """
    names = free_names(docs.columns, "lx_id", "lx_null", "lx_fp")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1])]
    print_ = each_text(F.col("text"), lambda t: _signed(fingerprint(t)), pa.int64()).alias(names[2])
    marked = saved(docs.select("*", *own, print_), "marked")
    prints = marked.select("doc_id", F.col(names[2]).alias("fp"))
    owned = _rooted(prints, "doc_id", bits, BUCKET_ROWS)
    least = owned.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), F.col("first").alias("doc_id"), "fp")).alias("least"))
    stay = least.select("least.doc_id", "least.fp").select(*own, F.col("fp").alias(names[2]))
    return marked.join(stay, names, "left_semi").dropDuplicates(names).select(*docs.columns)
