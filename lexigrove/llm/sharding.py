"""Sharding by sampled splitters: key ranges from a size-weighted sample, overfull ranges subdivided.

A record's key is a 52-bit hash of its text, so equal texts are neighbours. A size-weighted sample of keys gives
splitters at its quantiles; they cut the keys into many more ranges than there are shards, and into more of them the
more records there are, so that a range is one task's work at every size. A range that the sample left overfull is
sampled once more, by itself, and subdivided at the quantiles of that sample. A text whose copies overfill a range is cut
out of it and, where it must be split, subdivided by a hash of the id (by the record's place where even one id overfills it).
Within a range records are numbered and their bytes summed in key order, so a boundary between shards can fall between any
two records although no task ever holds more than a range.

Law: ``bytes``. Large groups of equal texts are placed first, whole where a shard has room for them (largest
first, on the emptiest shard), else in their subdivisions. The ranges, in key order, then fill the shards up to
one level. A group that isn't large (under ``large`` of a shard) goes where its first record falls, so equal
texts stay together and shards differ by a small part of a per cent, or by one record where records are larger.

What reaches the driver: the sample (``ranges * per_range`` keys or so, as arrays), the large groups (under
``shards / large`` by their definition) and a row for each range and each shard's part of it: about 40 numbers for each
``range_rows`` records.

Defined cases: a null text has no bytes and counts as the empty one; records equal in every respect get
consecutive slots; an empty table gives an empty result; extra columns are never looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARDS = 40
RANGES_PER_SHARD = 16
#: Records in a range, at most, about.
RANGE_ROWS = 1_000_000
PER_RANGE = 32
#: A range is overfull at this many times its share; it is subdivided at most so often.
OVERFULL, ROUNDS = 2.0, 4
LARGE = 1 / 200
OVERHEAD = 16


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 12).alias("key"),
        F.xxhash64(F.lit("order"), F.col(id_col)).alias("tie"),
    )


def splitters(recs: DataFrame, total: int, ranges: int, per_range: int = PER_RANGE) -> tuple[np.ndarray, np.ndarray]:
    """A size-weighted sample: rising keys, and how often each was drawn (as its share of bytes says, on average)."""
    wanted = ranges * per_range
    draw = F.pmod(F.xxhash64(F.lit("sample"), "key", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") * (wanted / max(1, total)) + draw).cast("long")
    rows = recs.select("key", times.alias("n")).where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def quantiles(keys: np.ndarray, drawn: np.ndarray, ranges: int) -> np.ndarray:
    """The keys that cut a sample into ranges of equal weight."""
    if not len(keys) or ranges < 2:
        return np.zeros(0, np.int64)
    reach = np.cumsum(drawn)
    return np.unique(keys[np.searchsorted(reach, reach[-1] * np.arange(1, ranges) / ranges, "left")])


def _range_of(cuts: np.ndarray):
    @F.pandas_udf("long")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key, "right").astype(np.int64))

    return run


def subdivided(recs: DataFrame, cuts: np.ndarray, fair: float) -> np.ndarray:
    """The cuts and, for each range over ``OVERFULL`` times its share, cuts at the quantiles of its own sample."""
    for _ in range(ROUNDS):
        ranged = recs.withColumn("range", _range_of(cuts)("key"))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * fair).toPandas()
        if not len(sums):
            break
        parts = dict(zip(sums["range"].tolist(), np.ceil(sums["bytes"] / fair).astype(int).tolist()))
        overfull = ranged.where(F.col("range").isin(list(parts)))
        keys, drawn = splitters(overfull, int(sums["bytes"].sum()), sum(parts.values()))
        home = np.searchsorted(cuts, keys, "right")
        finer = [quantiles(keys[home == r], drawn[home == r], n) for r, n in parts.items()]
        # A range of one large group has no further cut.
        more = np.unique(np.concatenate([cuts, *finer]))
        if len(more) == len(cuts):
            break
        cuts = more
    return cuts


def _fill(levels: list[int], amount: int) -> list[float]:
    """Room for each shard so that ``amount`` brings all as near to one level as their loads allow."""
    order, left = sorted(levels), float(amount)
    for i, low in enumerate(order):
        step = (order[i + 1] - low) * (i + 1) if i + 1 < len(order) else math.inf
        if left <= step:
            level = low + left / (i + 1)
            return [max(0.0, level - x) for x in levels]
        left -= step
    return [0.0] * len(levels)


def _place(units: list, shards: int, capacity: float):
    """Cut points: (unit, first byte) -> shard. ``units``: (unit, bytes, rows, key of a large group or None)."""
    loads = [(0, s) for s in range(shards)]
    heapq.heapify(loads)
    groups: dict[int, list] = {}
    for u in units:
        if u[3] is not None:
            groups.setdefault(u[3], []).append(u)
    items = []
    for key, members in groups.items():
        size = sum(m[1] for m in members)
        whole = size <= capacity or len(members) == 1
        items += [(size, members)] if whole else [(m[1], [m]) for m in members]
    parts = []

    def put(size, members):
        load, shard = heapq.heappop(loads)
        if len(members) > 1 and load + size > capacity:
            heapq.heappush(loads, (load, shard))
            for m in sorted(members, key=lambda m: -m[1]):
                put(m[1], [m])
            return
        parts.extend((m[0], 0, shard) for m in members)
        heapq.heappush(loads, (load + size, shard))

    for size, members in sorted(items, key=lambda x: (-x[0], x[1][0][0])):
        put(size, members)
    by_shard = [load for load, _ in sorted(loads, key=lambda x: x[1])]
    small = [u for u in units if u[3] is None]
    room = np.cumsum(_fill(by_shard, sum(u[1] for u in small)))
    start, shard = 0, 0
    for unit, size, _, _ in small:
        while shard < shards - 1 and room[shard] <= start + 1e-9:
            shard += 1
        parts.append((unit, 0, shard))
        s = shard
        while s < shards - 1 and room[s] < start + size:
            cut, s = room[s], s + 1
            parts.append((unit, int(math.ceil(cut - start)), s))
        start, shard = start + size, s
    return parts


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) for each row of ``docs``."""
    spark = docs.sparkSession
    recs = saved(records(docs, id_col, text_col), "records")
    sums = recs.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = sums.bytes or 0
    ranges = max(shards * RANGES_PER_SHARD, math.ceil(sums["rows"] / range_rows))
    cuts = quantiles(*splitters(recs, total, ranges), ranges)
    capacity = total / shards
    fair = max(1.0, total / ranges)
    large = (
        recs.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where(F.col("bytes") > capacity * LARGE)
    ).toPandas().sort_values("key")
    keys = large["key"].to_numpy(np.int64)
    # Large groups are placed by themselves: the ranges hold the rest.
    rest = recs.where(~F.col("key").isin(keys.tolist())) if len(keys) else recs
    cuts = subdivided(rest, cuts, fair)
    # A large group is cut out of its range; over the size of a range it gets subdivisions.
    parts_of = np.maximum(1, np.minimum(large["rows"], np.ceil(large["bytes"] / fair))).to_numpy(np.int64)
    base = len(cuts) + 1 + np.concatenate(([0], np.cumsum(parts_of)[:-1])).astype(np.int64)
    # Ids that overfill a subdivision by themselves are dealt by place.
    tied = recs.where(F.col("key").isin(keys.tolist())).groupBy("key", "tie").agg(F.sum("size").alias("bytes"))
    hot = np.sort(tied.where(F.col("bytes") > fair).toPandas()["tie"].to_numpy(np.int64)) if len(keys) else np.zeros(0, np.int64)

    @F.pandas_udf("long")
    def unit_of(key: pd.Series, tie: pd.Series, row: pd.Series) -> pd.Series:
        out = np.searchsorted(cuts, key, "right").astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key.to_numpy()
            deal = tie.to_numpy()[hit].view(np.uint64)
            deal = np.where(np.isin(tie.to_numpy()[hit], hot), row.to_numpy()[hit].astype(np.uint64), deal)
            out[hit] = base[at[hit]] + (deal % parts_of[at[hit]].view(np.uint64)).view(np.int64)
        return pd.Series(out)

    placed = saved(recs.withColumn("unit", unit_of("key", "tie", F.col("_metadata.row_index"))), "placed")
    found = placed.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("unit")
    owner = np.searchsorted(base, found["unit"].to_numpy(), "right") - 1
    units = [
        (u, b, n, int(keys[o]) if o >= 0 and u > len(cuts) else None)
        for u, b, n, o in zip(found["unit"].tolist(), found["bytes"].tolist(), found["rows"].tolist(), owner.tolist())
    ]
    pieces = sorted(_place(units, shards, capacity))
    # A place in the sequence of all records' bytes names the piece that it is in.
    unit_ids, unit_start = found["unit"].to_numpy(np.int64), np.concatenate(([0], np.cumsum(found["bytes"].to_numpy(np.int64))))
    piece_unit = np.array([p[0] for p in pieces], np.int64)
    piece_start = unit_start[np.searchsorted(unit_ids, piece_unit)] + np.array([p[1] for p in pieces], np.int64)
    piece_shard = np.array([p[2] for p in pieces], np.int64)

    in_order = Window.partitionBy("unit").orderBy("key", "tie", "size", "text_crc32")
    before = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("before", before).withColumn("row", F.row_number().over(in_order).cast("long"))
    # A group goes where its first record falls.
    numbered = numbered.withColumn("at", F.min("before").over(Window.partitionBy("unit", "key")))

    @F.pandas_udf("long")
    def piece_of(unit: pd.Series, at: pd.Series) -> pd.Series:
        place = unit_start[np.searchsorted(unit_ids, unit)] + at.to_numpy()
        return pd.Series(np.searchsorted(piece_start, place, "right") - 1)

    done = saved(numbered.withColumn("piece", piece_of("unit", "at")).drop("before", "at", "tie"), "shards")
    counts = done.groupBy("piece").agg(F.count("*").alias("n"), F.min("row").alias("first")).toPandas()
    number, first = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    number[counts["piece"]], first[counts["piece"]] = counts["n"], counts["first"]
    # Pieces of a shard follow one another in order.
    order = np.argsort(piece_shard, kind="stable")
    upto = np.concatenate(([0], np.cumsum(number[order])))[:-1]
    filled = np.empty(len(pieces), np.int64)
    starts = np.searchsorted(piece_shard[order], piece_shard[order])
    filled[order] = upto - upto[starts] if len(order) else upto
    offset = filled - first

    @F.pandas_udf("struct<shard int, slot long>")
    def slot_of(piece: pd.Series, row: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": piece_shard[piece].astype(np.int32), "slot": offset[piece] + row})

    out = done.withColumn("found", slot_of("piece", "row"))
    return out.select("doc_id", "size", "text_crc32", "found.shard", "found.slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
