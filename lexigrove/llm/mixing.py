"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Targets. Sources share ``total`` words in proportion to their weights; a source over ``cap`` times its own
size stops there and the excess goes to the others by weight until none is above (water-filling, found in
closed form from the sources in order of cap * size / weight).

Draws. A hash of id and text orders a source's documents at random; its leading bits cut the order into
permuted blocks. A source gives whole epochs (all blocks) and, for the rest of its target, the blocks up to a
threshold; in the last block documents are taken while that brings the sum nearer to the target. Rows equal in id
and text share a place in the order; where the threshold falls among them, as many of them are taken as bring the sum
nearest. So the words taken miss the target by half a row at most, and no row is taken more than ``cap`` times.

Shards. The block draws of all sources are one multiset. A binary tree over the output shards splits it: a node
passes a random half of its draws to the left, without replacement, which makes the counts by source
multivariate hypergeometric with exact row and column sums. A node's counts come from halving its sources again and
again: how many of a group's draws fall to its first half is hypergeometric, and is found by inverting the
distribution from its mode outwards, in about as many steps as its standard deviation. A leaf's counts say how many
of each source's permuted draws it owns; draws are disjoint. ``place`` is a random key for the local shuffle of a shard.

Sizes. A source has 2**k blocks, about one for each ``block_docs`` documents, 2**16 at most, so a block of a
source that holds a third of all rows stays small, and the tree works on counts of blocks, never on documents.
Documents are only ever joined to tables of sources and blocks, which Spark broadcasts where they are small. The
counts of all sources are one array in each node: sources are assumed to be fewer than a million.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; sources without
words get target 0 and give nothing; rows equal in id and text differ by one draw at most, and which of them gets
it is open; reruns agree in all else; extra columns are kept by :func:`sample`, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, n_words, new_folder, saved, table

WEIGHTS = (5, 2, 1)
CAP = 3
SHARDS = 64
BLOCK_DOCS = 256
_BITS = 62
#: A source has 2**MOST_BITS blocks at most.
MOST_BITS = 16


def _order(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in the random order of its source: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))), 64 - _BITS)


def _block(u: str, k: str) -> Column:
    return F.expr(f"cast(shiftright({u}, {_BITS} - {k}) as int)")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """From (source, source_size, docs), a row for each source: adds ord (code-point order) and target."""
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "ord")
    limit = F.col("source_size") * float(cap)
    out = (
        sizes.withColumn("ord", (F.row_number().over(by_source) - 1).cast("int"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("ord") % len(weights) + 1))
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(limit).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("before")) / F.col("rest"))
        .withColumn("open", F.col("level") * F.col("weight") <= limit)
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything))
    )
    at_cap = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return out.withColumn("target", F.when(at_cap, limit).otherwise(F.col("first.level") * F.col("weight"))).select(
        "source", "source_size", "docs", "ord", "target"
    )


def _plan(base: DataFrame, weights, cap: int, block_docs: int, share: float) -> DataFrame:
    """From (source, size, u): a row for each source with target, k, whole epochs, threshold, blocks of the last one."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    k = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("docs") / F.lit(float(block_docs)))))).cast("int")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = (
        targets(sizes, weights, cap, share)
        .withColumn("k", k)
        .withColumn("epochs", F.least(F.lit(cap), full).cast("int"))
        # A source at its cap has no part of an epoch left, whatever rounding says.
        .withColumn("remainder", F.when(F.col("epochs") < cap, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    )
    sources = saved(sources, "sources")
    same = base["source"].eqNullSafe(sources["source"])
    partial = sources.where("remainder > 0").drop("source_size", "docs")
    placed = base.join(partial, same).select("ord", "k", "remainder", "u", "size", _block("u", "k").alias("block"))
    blocks = placed.groupBy("ord", "block").agg(F.sum("size").alias("words"), F.first("remainder").alias("remainder"))
    run = Window.partitionBy("ord").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        blocks.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .where((F.col("before") <= F.col("remainder")) & (F.col("remainder") < F.col("before") + F.col("words")))
        .select("ord", F.col("block").alias("edge"), "before")
    )
    # Equal rows have one place: they are counted, so a large group of them is one row here.
    places = (
        placed.join(edge, "ord").where("block = edge").groupBy("ord", "u")
        .agg(F.count("*").alias("rows"), F.sum("size").alias("words"), F.first("before").alias("before"), F.first("remainder").alias("remainder"))
    )
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("ord").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("remainder") - F.col("reached")
    some = F.floor(room * F.col("rows") / F.col("words") + 0.5)
    takes = F.when(F.col("words") > 0, F.least(F.col("rows"), F.greatest(F.lit(0), some))).when(room >= 0, F.col("rows")).otherwise(0)
    last = (
        places.withColumn("reached", F.col("before") + earlier)
        .withColumn("takes", takes.cast("long"))
        .where("takes > 0")
        .groupBy("ord")
        .agg(F.max(F.struct("u", "takes", "rows")).alias("last"))
        .select("ord", F.col("last.u").alias("u_last"), F.col("last.takes").alias("takes"), F.col("last.rows").alias("equal_rows"))
    )
    threshold = F.coalesce("u_last", F.expr(f"shiftleft(cast(edge as bigint), {_BITS} - k) - 1"), F.lit(-1).cast("long"))
    part = F.when(F.col("u_last").isNotNull(), F.col("edge") + 1).otherwise(F.coalesce("edge", F.lit(0)))
    out = sources.join(edge.drop("before"), "ord", "left").join(last, "ord", "left")
    return out.select(
        "source", "source_size", "target", "ord", "k", "epochs", threshold.alias("threshold"), part.alias("part"),
        F.coalesce(F.col("takes") < F.col("equal_rows"), F.lit(False)).alias("divided"), "takes",
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL of a body in which ``name`` is a value computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_factorial(n: str) -> str:
    """SQL of ln n!: Stirling's series of (n + 8)!, less the factors beyond n; right to ten places."""
    z = f"({n} + 9D)"
    factors = " * ".join(f"({n} + {i}D)" for i in range(1, 9))
    return f"({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {z}) - 1D / (360D * {z} * {z} * {z}) - ln({factors})"


def _hypergeometric(total: str, good: str, drawn: str, hashed: str) -> str:
    """SQL of how many of ``drawn`` out of ``total`` are among its ``good``.

    It is the quantile at a 64-bit hash, searched from the mode outwards; beyond 12 standard deviations there is nothing to find.
    """
    given = f"named_struct('t', cast({total} as bigint), 'g', cast({good} as bigint), 'x', cast({drawn} as bigint), 'h', {hashed})"
    bounds = """struct(v.t AS t, v.g AS g, v.x AS x, greatest(0L, v.x - (v.t - v.g)) AS low, least(v.x, v.g) AS high,
        cast(floor((v.x + 1D) * (v.g + 1D) / (v.t + 2D)) as bigint) AS peak,
        cast(ceil(12 + 12 * sqrt(1D * v.x * v.g / v.t * (v.t - v.g) / v.t * (v.t - v.x) / greatest(v.t - 1, 1))) as bigint) AS steps,
        shiftrightunsigned(v.h, 11) / 9007199254740992D AS p)"""
    mode = "struct(w.t AS t, w.g AS g, w.x AS x, w.low AS low, w.high AS high, least(w.high, greatest(w.low, w.peak)) AS mode, w.steps AS steps, w.p AS p)"
    plus, minus = ["v.g", "v.t - v.g", "v.x", "v.t - v.x"], ["v.mode", "v.g - v.mode", "v.x - v.mode", "v.t - v.g - v.x + v.mode", "v.t"]
    at_mode = "exp(" + " + ".join(f"({_log_factorial(n)})" for n in plus) + "".join(f" - ({_log_factorial(n)})" for n in minus) + ")"
    up = "if(s.a < v.high, s.up * (v.g - s.a) * (v.x - s.a) / ((s.a + 1D) * (v.t - v.g - v.x + s.a + 1D)), 0D)"
    down = "if(s.b > v.low, s.down * s.b * (v.t - v.g - v.x + s.b) / ((v.g - s.b + 1D) * (v.x - s.b + 1D)), 0D)"
    step = _let(
        "n",
        f"struct({up} AS up, {down} AS down)",
        """struct(s.rest - n.up - n.down AS rest, n.up AS up, n.down AS down, least(s.a + 1, v.high) AS a, greatest(s.b - 1, v.low) AS b,
        CASE WHEN s.done THEN s.found WHEN s.rest < n.up THEN s.a + 1 WHEN s.rest < n.up + n.down THEN s.b - 1 ELSE s.found END AS found,
        s.done OR s.rest < n.up + n.down AS done)""",
    )
    start = "struct(v.p - m AS rest, m AS up, m AS down, v.mode AS a, v.mode AS b, v.mode AS found, false AS done)"
    walk = f"aggregate(sequence(1L, least(v.steps, greatest(v.mode - v.low, v.high - v.mode))), {start}, (s, i) -> {step}).found"
    search = _let("m", at_mode, f"if(v.p < m OR v.high <= v.low, v.mode, {walk})")
    drawn_some = _let("v", _let("w", _let("v", given, bounds), mode), search)
    return f"CASE WHEN {drawn} <= 0 OR {good} <= 0 THEN 0L WHEN {drawn} >= {total} THEN {good} WHEN {good} >= {total} THEN {drawn} ELSE {drawn_some} END"


def _pair_sums(finer: str, groups: int) -> Column:
    return F.expr(f"transform(sequence(0, {groups - 1}), i -> {finer}[2 * i] + {finer}[2 * i + 1])")


def _halved(j: int, seed: int) -> Column:
    """The draws that go left, of each group of level j, dealt to the two halves of the group."""
    first = _hypergeometric(f"sum{j}[i]", f"sum{j + 1}[2 * i]", "x", f"xxhash64({seed}, node, {j}, i)")
    return F.expr(f"flatten(transform(left{j}, (x, i) -> {_let('f', first, 'array(f, x - f)')}))")


def split(sources: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """From (ord, quota): rows (shard, ord, n) of a random split of all draws, shard totals at most one apart."""
    halvings = max(1, (max(1, sources.count()) - 1).bit_length())
    width = 1 << halvings
    zero = F.lit(0).cast("long")
    padded = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(F.col("all"), i)["quota"].cast("long"), zero))
    nodes = sources.agg(F.array_sort(F.collect_list(F.struct("ord", "quota"))).alias("all")).select(
        F.lit(1).cast("long").alias("node"),
        F.lit(0).alias("lo"),
        F.lit(shards).alias("hi"),
        F.transform("all", lambda x: x["ord"]).alias("ords"),
        padded.alias("quotas"),
    )
    for level in range(max(0, (shards - 1).bit_length())):
        # Written after each level: the plan of a whole tree would fill the driver. Eight nodes are dealt to tasks.
        nodes = saved(nodes.repartition("node") if level == 3 else nodes, "nodes") if level else nodes
        # Sums of groups of sources: level j has 2**j groups.
        nodes = nodes.withColumns({"mid": F.expr("(lo + hi + 1) div 2").cast("int"), f"sum{halvings}": F.col("quotas")})
        for j in reversed(range(halvings)):
            nodes = nodes.withColumn(f"sum{j}", _pair_sums(f"sum{j + 1}", 1 << j))
        # Shares are cut at whole multiples, so totals of equal shards differ by one at most.
        nodes = nodes.withColumn("left0", F.array(F.expr("sum0[0] * (mid - lo) div (hi - lo)").cast("long")))
        for j in range(halvings):
            nodes = nodes.withColumn(f"left{j + 1}", _halved(j, seed))
        left = F.col(f"left{halvings}")
        right = F.zip_with("quotas", left, lambda q, x: q - x)
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), "lo", F.col("mid").alias("hi"), left.alias("quotas")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("mid").alias("lo"), "hi", right.alias("quotas")),
        )
        nodes = nodes.select("ords", F.explode(children).alias("x")).select("x.node", "x.lo", "x.hi", "ords", "x.quotas")
        nodes = nodes.where("lo < hi")
    counts = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("ords", F.slice("quotas", 1, F.size("ords")).alias("quotas"))).alias("x"))
    return counts.select("shard", F.col("x.ords").alias("ord"), F.col("x.quotas").alias("n"))


def draws(plan: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Rows (ord, block, shards): the shard of each draw of a block, by epoch."""
    quota = F.col("epochs") * F.expr("shiftleft(1L, k)") + F.col("part")
    owned = split(plan.select("ord", quota.alias("quota")), shards, seed).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    slots = owned.withColumn("upto", upto).select(
        "ord", "shard", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("slot")
    )
    pool = plan.select("ord", "k", "part", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch"), "epochs")
    size = F.when(F.col("epoch") < F.col("epochs"), F.expr("shiftleft(1, k)")).otherwise(F.col("part"))
    pool = pool.withColumn("size", size.cast("int")).where("size > 0")
    pool = pool.select("ord", "epoch", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("block"))
    shuffled = Window.partitionBy("ord").orderBy(F.xxhash64(F.lit(seed), "ord", "epoch", "block"), "epoch", "block")
    pool = pool.withColumn("slot", F.row_number().over(shuffled).cast("long"))
    return (
        pool.join(slots, ["ord", "slot"])
        .groupBy("ord", "block")
        .agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("x"))
        .select("ord", "block", F.transform("x", lambda s: s["shard"]).alias("shards"))
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    cap: int = CAP,
    shards: int = SHARDS,
    block_docs: int = BLOCK_DOCS,
    share: float = 1.0,
    seed: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """For each row of ``docs``: the ``keep`` columns, size, source_size, target, shards (one for each copy taken)."""
    keep = ["doc_id"] if keep is None else keep
    mixed = _mixed(docs, keep, weights, cap, shards, block_docs, share, seed)
    return mixed.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *(F.col(c).alias(f"__{c}") for c in FOUND))


#: What :func:`mix` finds for each row (as ``__size`` and so on).
FOUND = ("size", "source_size", "target", "shards", "u")


def _mixed(docs: DataFrame, keep: list[str], weights, cap: int, shards: int, block_docs: int, share: float, seed: int) -> DataFrame:
    """keep_0, keep_1, ... (so that no column of the caller can clash), then what is found."""
    marked = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        _order("doc_id", "text", seed).alias("u"),
    )
    base = saved(marked.select("source", "size", "u"), "sizes")
    plan = saved(_plan(base, weights, cap, block_docs, share), "plan")
    owners = saved(draws(plan, shards, seed), "draws")
    named = plan.withColumnRenamed("source", "plan_source")
    joined = marked.join(named, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("block", _block("u", "k"))
    parted = F.col("divided") & (F.col("u") == F.col("threshold"))
    drawn = joined.withColumn("copies", F.col("epochs") + (F.col("u") <= F.col("threshold")).cast("int"))
    if plan.where("divided").take(1):
        # The threshold of a source falls among equal rows: these alone are numbered.
        equal = _numbered(joined.where(parted), "ord").withColumn("copies", F.col("epochs") + (F.col("number") <= F.col("takes")).cast("int"))
        drawn = drawn.where(~parted).unionByName(equal.drop("number"))
    drawn = drawn.join(owners, ["ord", "block"], "left")
    return drawn.select(
        *[f"keep_{i}" for i in range(len(keep))],
        "size",
        "source_size",
        "target",
        F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("copies")).alias("shards"),
        "u",
    )


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds number, from 1, within the rows of each ``by``; by places in written files, so no task gets them all."""
    path = new_folder(rows.sparkSession, "equal")
    rows.sortWithinPartitions(by).write.parquet(path)
    placed = rows.sparkSession.read.schema(rows.schema).parquet(path)
    placed = placed.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = placed.groupBy(by, "file").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select(by, "file", (before - F.col("first") + 1).alias("offset"))
    return placed.join(files, [by, "file"]).withColumn("number", F.col("at") + F.col("offset")).drop("file", "at", "offset")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; words taken of each."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.size("__shards")).alias("taken"),
    )


def _copies(docs: DataFrame, weights=WEIGHTS, cap=CAP, shards=SHARDS, block_docs=BLOCK_DOCS, share=1.0, seed=0) -> DataFrame:
    mixed = _mixed(docs, docs.columns, weights, cap, shards, block_docs, share, seed)
    return mixed.select(*[f"keep_{i}" for i in range(len(docs.columns))], "u", F.posexplode("shards").alias("copy", "shard"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """``docs`` mixed: each row as often as it is taken, with the columns of ``docs``."""
    return _copies(docs, **options).select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)])


def sharded(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """``docs`` mixed, dealt by shard and shuffled locally: the columns of ``docs``, then __shard and __place.

    Where ``docs`` has columns of these names, underscores are added to the new ones.
    """
    rows = _copies(docs, seed=seed, **options)
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), "shard", "copy", "u")).repartition("shard", F.pmod(F.col("place"), F.lit(8)))
    shard, place = free_names(docs.columns, "__shard", "__place")
    rows = rows.sortWithinPartitions("shard", "place")
    return rows.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("shard").alias(shard), F.col("place").alias(place))
