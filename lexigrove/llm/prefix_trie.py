"""Prefix trie of conversations: MSD radix partitioning over dictionary-encoded turns, multikey quicksort inside buckets.

A turn (role, text) becomes a number by a dictionary of the distinct turns; texts are read once and never shuffled (they meet
as two 64-bit hashes). A conversation is then the array of its turns' numbers, equal ones are combined into one sequence with its
least conversation and their count, and the trie is built over the distinct sequences.

Sequences of a bucket share a prefix. They are dealt by their next turn; a bucket of at most ``local_turns`` turns is local, a larger one
recurses: the longest prefix that all its sequences share (that of its least and greatest one) is a branching node above
the local buckets, and its sequences are dealt again by the turn after it. A round costs a count and a look-up of the large
buckets, whose number is at most that of all turns by ``local_turns``. Each local bucket streams through one task: multikey quicksort
parts its sequences by one turn at a time, and every class of equal turns is a node. Sums of the nodes above come from sums
of the topmost local nodes, each added to all branching nodes on its path.

Digests of the conversations that end at a node: pairs of sequence and conversation are sorted by range, so that one sequence
with very many conversations is spread over tasks; a task digests the sequences that it holds whole, and passes the first and the last as
pieces of joined numbers, which are digested in order.

Defined cases: a null role or text is empty; turns of equal number follow each other by a hash of role and text, nulls
first; repeated rows are turns each; rows without a conversation are left out; extra columns are never looked at; an
empty table has no node. A conversation is one row of 16 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: Turns of a bucket that one task finishes, and of a task, about.
LOCAL_TURNS, TASK_TURNS = 200_000, 500_000
#: Bytes of a piece of joined numbers.
PIECE_BYTES = 1 << 16
EMPTY = hashlib.sha256().hexdigest()


def _hashes(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2")]


def sequences(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): the turns in order, as (id, chars); ids are places in a dictionary written once."""
    clean = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    hashed = clean.select("conv_id", "turn", F.length("text").alias("chars"), *_hashes("role", "text"))
    dictionary = saved(hashed.select("h1", "h2").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = hashed.join(dictionary, ["h1", "h2"])
    # In a sort, a null turn comes before all others.
    order = F.struct("turn", "h1", "h2", "id", "chars")
    whole = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("all"))
    return whole.select("conv_id", F.transform("all", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(found: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation with its first turns from the one at the start of its hundred: crc32 of its number says how many."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    own = found.select("conv_id", "turns", head.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    first = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    none = F.array().cast(found.schema["turns"].dataType)
    begun = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    after = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns") - F.col("h"))).otherwise(none)
    return own.join(first, "base", "left").select("conv_id", F.concat(begun, after).alias("turns"))


def _key(ids: Column, k: str = "k") -> list[Column]:
    return [F.xxhash64(F.size(ids), ids).alias(f"{k}1"), F.xxhash64(F.lit("second"), ids).alias(f"{k}2")]


def _ends(convs: DataFrame, tasks: int) -> DataFrame:
    """From (k1, k2, conv_id): rows (k1, k2, ends), the digest of a sequence's conversations in order."""
    schema = "k1 long, k2 long, at long, ends string, piece binary"
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("ends", pa.string()), ("piece", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, at, joined, sha, first = None, None, [], None, True
        size = 0

        def close(whole: bool) -> None:
            nonlocal joined, size
            if whole:
                sha.update(",".join(joined).encode())
                out.append((*key, None, sha.hexdigest(), None))
            else:
                out.append((*key, at, None, ",".join(joined).encode()))
            joined, size = [], 0

        # The first and the last sequence of a range may go on in others, so their numbers are passed on.
        pieces: list[tuple[int, bytes]] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != key:
                    if key is not None:
                        if first:
                            close(False)
                            out.extend((*key, a, None, p) for a, p in pieces)
                        else:
                            for _, p in pieces:
                                sha.update(p + b",")
                            close(True)
                        first = False
                    key, at, joined, size, pieces, sha = (k1, k2), conv, [], 0, [], hashlib.sha256()
                if size > PIECE_BYTES:
                    # A sequence with very many conversations is rare: its pieces wait as bytes until it ends, or leave at once.
                    piece = ",".join(joined).encode()
                    if first:
                        out.append((*key, at, None, piece))
                    else:
                        pieces.append((at, piece))
                    at, joined, size = conv, [], 0
                word = str(conv)
                joined.append(word)
                size += len(word) + 1
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        if key is not None:
            out.extend((*key, a, None, p) for a, p in pieces)
            close(False)
        yield batch_of(out)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for k1, k2, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(piece)
                else:
                    sha.update(b"," + piece)
        if key is not None:
            out.append((*key, sha.hexdigest()))
        columns = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends"])

    sorted_ = convs.repartitionByRange(tasks, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    found = saved(sorted_.mapInArrow(digest, schema), "ends")
    split = found.where("piece is not null").repartition(tasks, "k1", "k2").sortWithinPartitions("k1", "k2", "at")
    chained = split.select("k1", "k2", "piece").mapInArrow(chain, "k1 long, k2 long, ends string")
    return found.where("ends is not null").select("k1", "k2", "ends").unionByName(chained)


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ARROW = pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in _NODE.split(", ")] + [("p1", pa.int64()), ("p2", pa.int64())])


class _Nodes:
    """Nodes of one bucket, parents before children."""

    def __init__(self) -> None:
        self.parent, self.depth, self.chars, self.n, self.first, self.ends = [], [], [], [], [], []

    def add(self, parent: int, depth: int, chars: int) -> int:
        for column, value in ((self.parent, parent), (self.depth, depth), (self.chars, chars), (self.n, 0), (self.first, None), (self.ends, EMPTY)):
            column.append(value)
        return len(self.parent) - 1

    def end(self, node: int, row: tuple) -> None:
        self.n[node] += row[2]
        self.first[node] = row[3] if self.first[node] is None else min(self.first[node], row[3])
        self.ends[node] = row[4]

    def rows(self) -> Iterator[tuple]:
        """Sums go up from the last node to the first."""
        size = len(self.parent)
        children, leaves, kept = [0] * size, [0] * size, [0] * size
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            kept[i] += (self.n[i] - 1) * self.chars[i]
            p = self.parent[i]
            if p >= 0:
                children[p] += 1
                leaves[p] += leaves[i]
                kept[p] += kept[i]
                self.n[p] += self.n[i]
                self.first[p] = self.first[i] if self.first[p] is None else min(self.first[p], self.first[i])
        for i in range(size):
            p = self.parent[i]
            yield self.first[i], self.depth[i], None if p < 0 else self.first[p], self.n[i], children[i], leaves[i], kept[i], self.ends[i]


def finish(rows: list[tuple], depth: int) -> Iterator[tuple]:
    """Nodes below a common prefix of ``depth`` turns, from distinct (ids, chars, n, first, ends) that are longer.

    Multikey quicksort: a range is parted around the turn of its middle sequence at the present depth. Those with a
    lesser or greater turn are parted again at the same depth; those with an equal one are a node, and go on a turn deeper.
    """
    nodes = _Nodes()
    todo = [(rows, depth, -1)]
    while todo:
        some, d, parent = todo.pop()
        if len(some) == 1:
            row = some[0]
            for i in range(d, len(row[0])):
                parent = nodes.add(parent, i + 1, row[1][i])
            nodes.end(parent, row)
            continue
        pivot = some[len(some) // 2][0][d]
        less, equal, more = [], [], []
        for row in some:
            turn = row[0][d]
            (equal if turn == pivot else less if turn < pivot else more).append(row)
        todo += [(part, d, parent) for part in (less, more) if part]
        node = nodes.add(parent, d + 1, equal[0][1][d])
        on = []
        for row in equal:
            if len(row[0]) == d + 1:
                nodes.end(node, row)
            else:
                on.append(row)
        if on:
            todo.append((on, d + 1, node))
    return nodes.rows()


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (p1, p2, next, depth, ids, chars, n, first, ends) in order of bucket: nodes, the topmost with their bucket's parent."""
    held, bucket, out = [], None, []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    def judged() -> Iterator[tuple]:
        p1, p2, _, depth = bucket
        for row in finish(held, depth):
            yield (*row, p1, p2) if row[2] is None else (*row, None, None)

    for batch in batches:
        for *key, ids, chars, n, first, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if key != bucket:
                if held:
                    out += judged()
                held, bucket = [], key
                if len(out) > 5000:
                    yield flush(out)
                    out = []
            held.append((ids, chars, n, first, ends))
    if held:
        out += judged()
    for at in range(0, len(out), 10_000):
        yield flush(out[at : at + 10_000])


def _shared(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a)).cast("int")


def trie(convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, turns): one row each."""
    spark = convs.sparkSession
    ids = F.transform("turns", lambda t: t["id"])
    convs = saved(convs.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars"), *_key(ids)), "rebuilt")
    turns = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-turns // TASK_TURNS))
    combined = convs.groupBy("k1", "k2", "ids", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    distinct = combined.join(_ends(convs.select("k1", "k2", "conv_id"), tasks), ["k1", "k2"])
    root = _key(F.array().cast("array<long>"), "p")
    path = F.array(F.struct(*root))
    active = saved(distinct.select("ids", "chars", "n", "first", "ends", F.lit(0).alias("depth"), *root, path.alias("path")), "sequences")
    top = active.limit(1).select("p1", "p2", "path", "depth", F.array().cast("array<int>").alias("segment"))
    crown, local, ended = [top], [], []
    # A round for each level of large buckets.
    while True:
        open_ = active.where(F.size("ids") > F.col("depth")).withColumn("next", F.col("ids")[F.col("depth")])
        ended.append(active.where(F.size("ids") == F.col("depth")).select("p1", "p2", "n", "first", "ends"))
        turns_of = F.sum((F.size("ids") - F.col("depth")).cast("long"))
        sizes = open_.groupBy("p1", "p2", "next").agg(F.count("*").alias("rows"), turns_of.alias("turns"))
        large = saved(sizes.where((F.col("rows") > 1) & (F.col("turns") > local_turns)).select("p1", "p2", "next", F.lit(True).alias("large")), "large")
        if not large.take(1):
            local.append(open_)
            break
        marked = open_.join(large, ["p1", "p2", "next"], "left")
        local.append(marked.where("large is null").select(*open_.columns))
        again = marked.where("large")
        ends = again.groupBy("p1", "p2", "next").agg(F.min(F.struct("ids", "chars")).alias("low"), F.max("ids").alias("high"))
        common = _shared(F.col("low.ids"), F.col("high"))
        branch = ends.select("p1", "p2", "next", common.alias("to"), *_key(F.slice("low.ids", F.lit(1), common), "q"), F.slice("low.chars", F.lit(1), common).alias("prefix_chars"))
        branch = saved(branch, "branches")
        below = again.join(branch, ["p1", "p2", "next"])
        deeper = below.withColumn("path", F.concat("path", F.array(F.struct(F.col("q1").alias("p1"), F.col("q2").alias("p2")))))
        segment = F.slice("prefix_chars", F.col("depth") + 1, F.col("to") - F.col("depth")).alias("segment")
        # Of the rows of a branching node any has its path and depth.
        crown.append(
            deeper.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
                F.first("path").alias("path"), F.first("to").alias("depth"), F.first(segment).alias("segment")
            )
        )
        active = saved(
            deeper.select("ids", "chars", "n", "first", "ends", F.col("to").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "path"), "sequences"
        )

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    columns = ["p1", "p2", "next", "depth", "ids", "chars", "n", "first", "ends"]
    buckets = all_of(local).select(*columns).repartition(tasks, "p1", "p2", "next").sortWithinPartitions("p1", "p2", "next")
    nodes = saved(buckets.mapInArrow(_finished, _NODE + ", p1 long, p2 long"), "nodes")
    crown_ = saved(all_of(crown), "crown")
    above = saved(_above(crown_, nodes.where("p1 is not null"), all_of(ended)), "above")
    parents = above.where("branch").select("p1", "p2", F.col("conv_id").alias("above"))
    inner = nodes.join(parents, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    names = [c.split()[0] for c in _NODE.split(", ")]
    return inner.select(*names).unionByName(above.select(*names))


def _above(crown: DataFrame, tops: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes on the paths to the branching nodes: what is directly below each is summed up to all on its path."""
    key = ["p1", "p2"]
    below = tops.groupBy(*key).agg(
        F.count("*").alias("tops"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("first"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("kept")
    )
    end = ended.select(*key, F.col("n").alias("end_n"), F.col("first").alias("end_first"), "ends")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = crown.join(below, key, "left").join(end, key, "left").select(
        *key, "path", "depth", "segment", zero("tops").alias("tops"), (zero("n") + zero("end_n")).alias("n"), F.least("first", "end_first").alias("first"),
        zero("leaves").alias("leaves"), zero("kept").alias("kept"), F.coalesce("ends", F.lit(EMPTY)).alias("ends"),
    )
    up = lambda df, *sums: df.withColumn("on", F.explode("path")).groupBy(F.col("on.p1").alias("p1"), F.col("on.p2").alias("p2")).agg(*sums)
    total = up(each, F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("leaves").alias("leaves"), F.sum("kept").alias("kept"))
    chars = F.aggregate("segment", F.lit(0).cast("long"), lambda n, c: n + c)
    own = each.select(*key, "path", "depth", "segment", "tops", "ends").join(total, key).withColumn("own", (F.col("n") - 1) * chars)
    own = saved(own, "totals")
    # What nodes strictly below save on their own segments, and the number of branching children.
    strict = own.where(F.size("path") > 1).withColumn("path", F.slice("path", F.lit(1), F.size("path") - 1))
    lower = up(strict, F.sum("own").alias("lower"))
    parent = F.col("path")[F.size("path") - 2]
    inner = strict.select(F.col("path")[F.size("path") - 1].alias("on")).groupBy("on.p1", "on.p2").agg(F.count("*").alias("inner"))
    first_of = own.select(F.col("p1").alias("o1"), F.col("p2").alias("o2"), F.col("first").alias("above"))
    joined = own.join(lower, key, "left").join(inner, key, "left").withColumns({"o1": F.when(F.size("path") > 1, parent["p1"]), "o2": F.when(F.size("path") > 1, parent["p2"])}).join(first_of, ["o1", "o2"], "left")
    # Places of a segment from the last, the branching node, up; the root has no turn but is a node.
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.size("segment"), F.lit(1)) - 1))
    node = joined.withColumn("up", place)
    branch = F.col("up") == 0
    tail = F.aggregate(F.slice("segment", F.size("segment") - F.col("up"), F.col("up") + 1), F.lit(0).cast("long"), lambda n, c: n + c)
    tail = F.when(F.size("segment") > 0, tail).otherwise(0)
    children = F.when(branch, F.col("tops") + zero("inner")).otherwise(1)
    return node.select(
        *key,
        branch.alias("branch"),
        F.col("first").alias("conv_id"),
        (F.col("depth") - F.col("up")).cast("long").alias("depth"),
        F.when(F.col("up") < F.size("segment") - 1, F.col("first")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n").cast("long").alias("n_convs"),
        children.cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("kept") + zero("lower") + (F.col("n") - 1) * tail).cast("long").alias("saved_tokens"),
        F.when(branch, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))
