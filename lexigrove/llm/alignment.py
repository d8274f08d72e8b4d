"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

Python only tokenises: a row gets the end offsets of both tokenizers' tokens (A: byte-level BPE ranks; B: a sentencepiece model), and by
offset the token that ends there. All else are array functions of Spark. ``array_intersect`` of the two end arrays
gives the ends that both share, and so the groups; ``slice``, ``filter`` and ``transform`` cut the ids into groups
at these, and ``aggregate`` counts links. Every step is linear in the text, but for the sort of a row's links. A link is a pair of
tokens of one group, coded as one number. Groups end at most word boundaries, so they are short; their pairs are the result asked for.

Counts: a link's number of documents is a combined count over the distinct links of each row. Rows then look up their links. The
number of distinct links grows with the corpus, so only the ``most_broadcast`` (at most) most frequent ones are sent to all
tasks: those over a power of two that keeps within the bound, found in a histogram of 64 rows at most. These are nearly all occurrences;
the rest, each of a number of documents below that power, are joined by a shuffle.

Rows and links are written once to the shared folder, with a number for each row, so that nothing is tokenised twice.

Defined cases: a text that is null or empty, or that isn't what its tokens' bytes say (bytes that aren't UTF-8, signs that B normalises),
has no tokens; repeated rows are counted as documents each; equal counts are all best; extra columns are never looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import load_ranks
from .common import new_folder, saved, table, text_bytes

#: Links sent to all tasks, at most.
MOST_BROADCAST = 500_000
#: Texts whose tokens are in memory at once.
TEXTS = 64
NONE = np.zeros(0, np.int32)
#: Matches what ``public_tokenizers.PATTERN`` does, with less going back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Bits of an id. A link is its A id above them and its B id in them.
ID_BITS = 17
ID_MASK = (1 << ID_BITS) - 1


@lru_cache(2)
def _byte_level(path: str, pattern: str):
    import tiktoken

    ranks = load_ranks(path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int32)
    for piece, rank in ranks.items():
        sizes[rank] = len(piece)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model, np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces)), np.int32)


def _encoded(raws: list[bytes | None], ranks: str, pattern: str, model: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A's and B's ids of each text; none where they don't spell it."""
    first = _byte_level(ranks, pattern)[0]
    second, signs, sizes = _pieces(model)
    places = np.cumsum(sizes, dtype=np.int64) - sizes
    # Bytes that aren't UTF-8 are read as others. A's tokens spell what they are given.
    texts = [raw.decode("utf-8", "replace") if raw else "" for raw in raws]
    a, b = [], []
    for raw, text, found in zip(raws, texts, second.encode(texts, num_threads=1)):
        ids = np.frombuffer(array("i", found), np.int32)
        long = sizes[ids]
        ends = np.cumsum(long, dtype=np.int64)
        same = raw and len(ids) and ends[-1] == len(raw) + 1
        same = same and signs[np.repeat(places[ids] - ends + long, long) + np.arange(ends[-1])].tobytes() == b" " + raw
        a.append(first.encode_to_numpy(" " + text, disallowed_special=()) if same else NONE)
        b.append(ids if same else NONE)
    return a, b


def _columns(parts: list[np.ndarray], sizes: np.ndarray, shift: int) -> list[pa.Array]:
    """Of each text the end offsets of its tokens, and for each offset the token that ends there."""
    counts = np.array([len(part) for part in parts], np.int64)
    stops = np.cumsum(counts)
    ids = np.concatenate(parts)
    long = sizes[ids].astype(np.int64)
    through = np.concatenate([np.zeros(1, np.int64), np.cumsum(long)])
    before = through[stops - counts]
    ends = through[1:] - np.repeat(before, counts)
    rows = through[stops] - before + 1
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(rows)])
    at = np.zeros(int(starts[-1]), np.int64)
    at[np.repeat(starts[:-1], counts) + ends] = (long << 2 * ID_BITS) + (ids.astype(np.int64) << shift)
    to = lambda x: pa.array(x, pa.int32())
    offsets = np.concatenate([np.zeros(1, np.int64), stops])
    return [pa.ListArray.from_arrays(to(offsets), to(ends)), pa.ListArray.from_arrays(to(starts), pa.array(at))]


def tokens(df: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, a_ends, a_at, b_ends, b_at): end offsets, and by offset the token that ends there, or 0: its length above the bits of a link, and
    its id where a link has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_sizes, b_sizes = _byte_level(ranks, pattern)[1], _pieces(model)[2]
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                a, b = _encoded(part.column(1).to_pylist(), ranks, pattern, model)
                lists = [*_columns(a, a_sizes, ID_BITS), *_columns(b, b_sizes, 0)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=schema.names)

    kind = lambda x: T.ArrayType(x, containsNull=False)
    # Arrays that hold no nulls are sorted as plain numbers.
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType)])
    for side in "ab":
        schema = schema.add(f"{side}_ends", kind(T.IntegerType()), False).add(f"{side}_at", kind(T.LongType()), False)
    return df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, schema)


def shared_ends(tokens: DataFrame) -> DataFrame:
    """Adds ``shared``, the ends that both have, in order, and ``before``, the same from a zero on: a group goes from one to the other."""
    shared = tokens.withColumn("shared", F.array_intersect("a_ends", "b_ends"))
    # Used more than once from here on, so the optimizer keeps the steps apart.
    return shared.withColumn("before", F.concat(F.array(F.lit(0)), F.col("shared")))


def _ids(side: str, j: Column) -> Column:
    """The ids of the ``j``-th group's tokens."""
    start, end = F.col("before")[j], F.col("shared")[j]
    ending = F.filter(F.slice(f"{side}_at", start + 2, end - start), lambda x: x > 0)
    return F.transform(ending, lambda x: F.shiftright(x, ID_BITS if side == "a" else 0).bitwiseAND(ID_MASK))


def groups(shared: DataFrame) -> DataFrame:
    """Rows (id, groups): an array of (a, b), the ids of each group's tokens."""
    cut = F.transform("shared", lambda _, j: F.struct(_ids("a", j).alias("a"), _ids("b", j).alias("b")))
    return shared.select("id", cut.alias("groups"))


def links(shared: DataFrame) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, groups_sha256, links): links in order of their numbers.

    Most groups are one token of each: the tokens that end at a shared end are equally long, and so began at one. Where they are, the
    exclusive or of both (:func:`tokens`) has no length left and is the link. The other groups are cut by :func:`_ids`.
    """
    above = 1 << 2 * ID_BITS
    first = shared.withColumn("met", F.transform("shared", lambda end: F.col("a_at")[end].bitwiseXOR(F.col("b_at")[end])))
    met = F.col("met")
    numbers = F.when(F.size(met) > 0, F.filter(F.sequence(F.lit(0), F.size(met) - 1), lambda j: met[j] >= above)).otherwise(F.array().cast("array<int>"))
    large = F.transform(numbers, lambda j: F.struct(_ids("a", j).alias("a"), _ids("b", j).alias("b")))
    cut = first.withColumn("large", large)
    joined = lambda ids: F.array_join(ids.cast("array<string>"), ",")

    def spelled(x: Column) -> Column:
        return F.when(x < above, F.concat(F.shiftright(x, ID_BITS).cast("string"), F.lit("|"), x.bitwiseAND(ID_MASK).cast("string")))

    # Large groups are cut once: the others are spelled with gaps, and what is between two gaps is followed by the large group there.
    between = F.split(F.array_join(F.transform(met, spelled), ";", "_"), "_")
    text = F.array_join(F.zip_with(between, F.transform("large", lambda g: F.concat(joined(g["a"]), F.lit("|"), joined(g["b"]))), lambda x, g: F.concat(x, F.coalesce(g, F.lit("")))), "")
    digest = F.when(F.size(met) > 0, F.sha2(text.cast("binary"), 256)).otherwise("")
    pairs = F.transform("large", lambda g: F.flatten(F.transform(g["a"], lambda a: F.transform(g["b"], lambda b: F.shiftleft(a, ID_BITS) + b))))
    n_large = F.aggregate("large", F.lit(0).cast("long"), lambda n, g: n + F.size(g["a"]).cast("long") * F.size(g["b"]))
    out = cut.select(
        "id", F.size("a_ends").cast("long").alias("n_a"), F.size("b_ends").cast("long").alias("n_b"), F.size(met).cast("long").alias("n_groups"),
        (F.size(met) - F.size("large") + n_large).alias("n_links"), digest.alias("groups_sha256"),
        # Numbers that aren't links are above all links.
        F.sort_array(F.concat(met, F.flatten(pairs))).alias("sorted"),
    )
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.slice("sorted", F.lit(1), F.col("n_links").cast("int")).alias("links"))


def link_counts(rows: DataFrame) -> DataFrame:
    """Rows (link, n, best): in how many rows a link is, and whether none of its A id's links is in more."""
    n = rows.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    n = saved(n, "link-counts")
    first = F.shiftright("link", ID_BITS)
    most = n.groupBy(first.alias("first")).agg(F.max("n").alias("most"))
    return n.join(most, first == F.col("first")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def align(
    df: DataFrame, ranks: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, groups_sha256, links, n_best, count_sum)."""
    spark = df.sparkSession
    if max(len(_byte_level(ranks, pattern)[1]), len(_pieces(model)[2])) > 1 << ID_BITS:
        raise ValueError(f"ids of more than {ID_BITS} bits")
    found = links(shared_ends(tokens(df, ranks, pattern, model, id_col, text_col)))
    path = new_folder(spark, "aligned")
    found.withColumn("row", F.monotonically_increasing_id()).write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)
    rows = spark.read.parquet(path)
    counts = saved(link_counts(rows), "links")
    power = F.floor(F.log2("n")).cast("int")
    left, least = most_broadcast, None
    histogram = counts.groupBy(power.alias("power")).count().collect()
    for r in sorted(histogram, key=lambda r: -r.power):
        left -= r["count"]
        if left < 0:
            break
        least = r.power
    totals = [F.sum("n").alias("count_sum"), F.sum(F.col("best").cast("long")).alias("n_best")]
    each = rows.select("row", F.explode("links").alias("link"))
    rare = counts if least is None else counts.where(power < least)
    parts = []
    if least is not None:
        # At most ``most_broadcast`` rows, by the histogram.
        frequent = F.broadcast(counts.where(power >= least))
        parts.append(each.join(frequent, "link").groupBy("row").agg(*totals))
        each = each.join(frequent.select("link"), "link", "left_anti")
    if least is None or min(r.power for r in histogram) < least:
        parts.append(each.join(rare, "link").groupBy("row").agg(*totals))
    summed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.join(summed, "row", "left")
    return out.select(F.col("id").alias(id_col), *rows.columns[1:-1], zero("n_best"), zero("count_sum"))


def default_tokenizers() -> tuple[str, str, str]:
    """The ranks of byte_bpe_50k.json (the same vocabulary, read three times as fast), a pattern, and the piece model."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), PATTERN, public.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their counts of every whole text of documents."""
    return align(table(spark, sf_dir, "documents"), *default_tokenizers()).drop("links")
