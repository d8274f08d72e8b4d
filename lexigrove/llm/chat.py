"""Chat formatting: roles of transcript turns recovered by a hidden Markov model, then canonical rendering.

A row (conversation, turn, text) is cut into units: a unit starts with the row, or with a line that carries a speaker
marker (``User:``, ``### Assistant:``, ``<|system|>`` ...). The hidden state of a unit is its role. It emits the marker
(or none), the number of lines and of characters (in powers of two), and for each line its length, whether it
asks, lists or shows code. Probabilities are counted on labelled rows, smoothed; markers have a strong prior.
Viterbi finds the best roles of the whole conversation; each unit is then rendered as ``<|role|>``, its text
without marker, ``<|end|>``.

Rows are shuffled once: dealt by conversation, sorted by turn and decoded as they stream, one conversation at a time.
A conversation of over ``large_turns`` rows doesn't meet in one task: its rows are dealt by ranges of (conversation, turn,
text) into pieces of about ``piece_turns``; each edge piece first reports the best score from every role before it to
every role at its end (a small matrix; at most two conversations a piece report), the driver chains these per
conversation and fixes the roles at the seams, and each piece decodes between its seams. Decoding is exact either way.

Fitting counts each feature over all labelled rows (sums, pre-aggregated); the driver gets one row for each (role,
feature value) and each pair of roles. The set of roles is assumed to be small.

Defined cases: a null text is the empty one; repeated rows (same conversation, turn and text) are one turn with
``copies``; rows with the same turn follow each other by a hash of their text, null turns come first, null
conversations are one conversation; equal scores choose the role first in code-point order; without labelled rows
every role is ``user``; ``<|`` inside a text is written ``< |`` so that it can't forge a turn; extra columns are never
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import crc_fold, saved, table

#: Words that mark a speaker, by role.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "student"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "agent", "answer", "a", "model", "gpt"),
}
_ROLE_OF = {w: role for role, words in MARKERS.items() for w in words}
_MARKER = re.compile(
    rf"[ \t]*(?:\#{{1,4}}[ ]*|\*\*|<\|(?:im_start\|>)?|\[)?({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})(?:\*\*)?[ ]?(?:\|>|:(?:\*\*)?|\])[ \t]*",
    re.IGNORECASE,
)
_LISTED = re.compile(r"\s*(?:[-*•]|[0-9]{1,3}[.)])\s")
#: Pseudo-counts of a marker under its own role, and of anything else.
SURE, PRIOR = 50.0, 0.5


def _size(n: int) -> int:
    return min(16, n.bit_length())


def units(text: str | None) -> list[tuple[str | None, str]]:
    """(role of the marker or None, text without it) of each unit of a row; at least one."""
    out: list[tuple[str | None, list[str]]] = []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = _MARKER.match(line)
        if m:
            out.append((_ROLE_OF[m[1].lower()], [line[m.end() :]]))
        elif out:
            out[-1][1].append(line)
        else:
            out.append((None, [line]))
    if len(out) > 1 and out[0][0] is None and not "".join(out[0][1]).strip():
        del out[0]
    return [(role, "\n".join(lines).strip()) for role, lines in out]


def features(marker: str | None, text: str) -> list[str]:
    """What a unit emits."""
    lines = [x for x in text.split("\n") if x.strip()]
    out = [f"marker={marker or ''}", f"lines={_size(len(lines))}", f"chars={_size(len(text))}"]
    for line in lines[:1] + lines[-1:] if lines else []:
        out.append(f"edge={_size(len(line))}")
    out += ["asks"] * any(x.rstrip().endswith("?") for x in lines)
    out += ["lists"] * any(_LISTED.match(x) for x in lines)
    out += ["code"] * ("```" in text)
    return out


@dataclass
class Model:
    roles: list[str]
    start: np.ndarray
    move: np.ndarray
    emit: dict[str, np.ndarray]
    rare: np.ndarray

    def score(self, marker: str | None, text: str) -> np.ndarray:
        total = np.zeros(len(self.roles))
        for f in features(marker, text):
            total = total + self.emit.get(f, self.rare)
        return total


def fit(rows: DataFrame) -> Model:
    """From (conv_id, turn, role, text); rows without a role are left out."""
    labelled = rows.select("conv_id", "turn", "role", "text").where(F.col("role").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: dict[tuple, int] = defaultdict(int)
            for role, text in zip(batch["role"], batch["text"]):
                for marker, part in units(text):
                    total[role, ""] += 1
                    for f in features(marker, part):
                        total[role, f] += 1
            yield pd.DataFrame([(r, f, n) for (r, f), n in total.items()], columns=["role", "feature", "n"])

    emitted = labelled.mapInPandas(count, "role string, feature string, n long").groupBy("role", "feature").agg(F.sum("n").alias("n"))
    one = labelled.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    after = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("last"))
    moves = one.join(after, ["conv_id", "turn"], "left").groupBy("last", "role").count().collect()
    counts = emitted.collect()
    roles = sorted({r.role for r in counts}, key=lambda s: s.encode()) or ["user"]
    at = {r: i for i, r in enumerate(roles)}
    start, move = np.full(len(roles), PRIOR), np.full((len(roles), len(roles)), PRIOR)
    for r in moves:
        if r["last"] is None:
            start[at[r.role]] += r["count"]
        else:
            move[at[r["last"]], at[r.role]] += r["count"]
    units_of, table_ = np.full(len(roles), 2 * PRIOR), defaultdict(lambda: np.full(len(roles), PRIOR))
    for r in counts:
        if r.feature:
            table_[r.feature][at[r.role]] += r.n
        else:
            units_of[at[r.role]] += r.n
    for role in MARKERS:
        if role in at:
            table_[f"marker={role}"][at[role]] += SURE
    return Model(
        roles,
        np.log(start / start.sum()),
        np.log(move / move.sum(axis=1, keepdims=True)),
        {f: np.log(c / units_of) for f, c in table_.items()},
        np.log(PRIOR / units_of),
    )


def passage(model: Model, scores: list[np.ndarray], first: bool) -> np.ndarray:
    """Best score from each role before the units to each role of the last one (rows alike at the very start)."""
    k = len(model.roles)
    best = None
    for s in scores:
        if best is None:
            best = (np.tile(model.start, (k, 1)) if first else model.move) + s
        else:
            best = (best[:, :, None] + model.move[None]).max(axis=1) + s
    return best


def decode(model: Model, scores: list[np.ndarray], before: int | None = None, last: int | None = None) -> list[int]:
    """Best roles of consecutive units, given the role before them and that of the last one where these are fixed."""
    back = []
    best = None
    for s in scores:
        if best is None:
            best = (model.start if before is None else model.move[before]) + s
        else:
            step = best[:, None] + model.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s
    at = int(best.argmax()) if last is None else last
    path = [at]
    for b in reversed(back):
        at = int(b[at])
        path.append(at)
    return path[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>"


_ORDER = ["__piece", "__conv", "conv_id", "turn", "__hash"]
_KEPT = ["__piece", "__conv", "conv_id", "turn", "text", "copies"]
#: Turns put in one batch of results.
_TURNS = 2000
#: Rows of a conversation that one task decodes, of a piece of a larger one, and of a task, about.
LARGE_TURNS, PIECE_TURNS, TASK_TURNS = 100_000, 50_000, 200_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((piece, conversation), its rows of (conv_id, turn, text, copies)), which arrive together; equal rows are one."""
    held: list[tuple] = []
    held_key = None
    for batch in batches:
        for piece, conv, *row in zip(*(batch.column(c).to_pylist() for c in _KEPT)):
            if (piece, conv) != held_key:
                if held:
                    yield held_key, held
                held, held_key = [], (piece, conv)
            if held and held[-1][:3] == tuple(row[:3]):
                held[-1] = (*row[:3], held[-1][3] + row[3])
            else:
                held.append(tuple(row))
    if held:
        yield held_key, held


def format_turns(rows: DataFrame, model: Model, large_turns: int = LARGE_TURNS, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """From (conv_id, turn, text): rows (conv_id, turn, part, role_pred, rendered, copies), one for each unit."""
    spark = rows.sparkSession
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__conv")
    marked = rows.select("conv_id", "turn", "text", conv, F.xxhash64("text").alias("__hash"))
    sizes = saved(rows.groupBy(conv).agg(F.count("*").alias("n")), "sizes")
    totals = sizes.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > large_turns, F.col("n"))).alias("large")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(totals.n or 0) // TASK_TURNS))

    def whole(df: DataFrame) -> DataFrame:
        dealt = df.withColumns({"__piece": F.lit(0), "copies": F.lit(1).cast("long")}).repartition(tasks, "__conv")
        return _written(dealt.sortWithinPartitions(*_ORDER, "text"), model, {}, rows)

    if not totals.large:
        return whole(marked)
    names = sizes.where(F.col("n") > large_turns).select("__conv")
    large = _in_pieces(marked.join(names, "__conv", "left_semi"), model, -(-totals.large // piece_turns), rows)
    return whole(marked.join(names, "__conv", "left_anti")).unionByName(large)


def _in_pieces(marked: DataFrame, model: Model, pieces: int, rows: DataFrame) -> DataFrame:
    distinct = marked.groupBy("__conv", "conv_id", "turn", "__hash", "text").agg(F.count("*").alias("copies"))
    dealt = distinct.repartitionByRange(pieces, "__conv", "conv_id", "turn", "__hash").withColumn("__piece", F.spark_partition_id())
    data = saved(dealt, "turns")
    # Conversations found in more than one piece; a piece shares at most its first and its last.
    shared = data.groupBy("__conv", "__piece").agg(F.lit(1).alias("one")).groupBy("__conv").agg(F.count("*").alias("n")).where("n > 1")
    seams: dict[tuple[str, int], tuple[int | None, int | None]] = {}

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (piece, conv), rows in _pieces(batches):
            scores = [model.score(*u) for _, _, text, _ in rows for u in units(text)]
            ways = [pa.array([passage(model, scores, first).ravel().tolist()], pa.list_(pa.float64())) for first in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([piece], pa.int32()), *ways], names=["conv", "piece", "at_start", "later"])

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartitionById(pieces, F.col("__piece")).sortWithinPartitions(*_ORDER, "text")

    edge = data.join(shared.select("__conv"), "__conv", "left_semi").select(*data.columns)
    found = in_order(edge).mapInArrow(report, "conv string, piece int, at_start array<double>, later array<double>").collect()
    k = len(model.roles)
    by_conv = defaultdict(list)
    for r in found:
        by_conv[r.conv].append(r)
    for conv, parts in by_conv.items():
        parts.sort(key=lambda r: r.piece)
        ways = [np.array(r.at_start if i == 0 else r.later).reshape(k, k) for i, r in enumerate(parts)]
        reach = [ways[0][0]]
        for w in ways[1:]:
            reach.append((reach[-1][:, None] + w).max(axis=0))
        ends = [int(reach[-1].argmax())]
        for i in range(len(parts) - 1, 0, -1):
            ends.append(int((reach[i - 1] + ways[i][:, ends[-1]]).argmax()))
        ends.reverse()
        for i, r in enumerate(parts):
            seams[conv, r.piece] = (ends[i - 1] if i else None, ends[i])

    return _written(in_order(data), model, seams, rows)


def _written(data: DataFrame, model: Model, seams: dict, rows: DataFrame) -> DataFrame:
    """Decoded and rendered units of rows that arrive by piece, conversation and turn."""
    kinds = dict(rows.select("conv_id", "turn").dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part int, role_pred string, rendered string, copies long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush():
            columns = zip(*out) if out else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for (piece, conv), rows in _pieces(batches):
            cut = [units(text) for _, _, text, _ in rows]
            scores = [model.score(*u) for parts in cut for u in parts]
            path = iter(decode(model, scores, *seams.get((conv, piece), (None, None))))
            for (conv_id, turn, _, copies), parts in zip(rows, cut):
                for j, (_, text) in enumerate(parts):
                    role = model.roles[next(path)]
                    out.append((conv_id, turn, j, role, render(role, text), copies))
            if len(out) >= _TURNS:
                yield flush()
                out = []
        yield flush()

    return data.select(*_KEPT).mapInArrow(write, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the conversations outside the held-out fold; recover the roles of all turns and render them."""
    rows = table(spark, sf_dir, "conversations")
    model = fit(rows.where(crc_fold("conv_id", 5) != 0))
    return format_turns(rows, model).withColumn("held_out", crc_fold("conv_id", 5) == 0)
