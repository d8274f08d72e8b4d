import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import chat


def test_units():
    assert chat.units("User: hi\nthere\n### Assistant: yes\n\nand so") == [("user", "hi\nthere"), ("assistant", "yes\n\nand so")]
    assert chat.units("<|system|> be kind\r\n**Human:** x") == [("system", "be kind"), ("user", "x")]
    assert chat.units(None) == chat.units("") == [(None, "")]
    assert chat.units("A plain text: no marker") == [(None, "A plain text: no marker")]
    assert chat.render("user", "say <|end|>") == "<|user|>\nsay < |end|>\n<|end|>"


def model(rng, k=3):
    roles = ["assistant", "system", "user"][:k]
    return chat.Model(roles, np.log(rng.dirichlet([1] * k)), np.log(rng.dirichlet([1] * k, k)), {}, np.zeros(k))


def test_viterbi_and_pieces_against_all_paths():
    rng = np.random.default_rng(19)
    for _ in range(30):
        m = model(rng)
        scores = [rng.normal(size=3) for _ in range(6)]

        def total(path):
            s = m.start[path[0]] + scores[0][path[0]]
            return s + sum(m.move[a, b] + scores[i + 1][b] for i, (a, b) in enumerate(zip(path, path[1:])))

        best = max(itertools.product(range(3), repeat=6), key=total)
        assert tuple(chat.decode(m, scores)) == best
        one, two = chat.passage(m, scores[:2], True), chat.passage(m, scores[2:], False)
        joined = one[0][:, None] + two
        last = int(joined.max(axis=0).argmax())
        seam = int(joined[:, last].argmax())
        assert tuple(chat.decode(m, scores[:2], None, seam) + chat.decode(m, scores[2:], seam, last)) == best


def test_long_conversation_spans_pieces(spark):
    rng = random.Random(20)
    rows = [(7, t, rng.choice(["user", "assistant"]), "word " * rng.randint(1, 60)) for t in range(2000)]
    rows += [(c, t, ["user", "assistant"][t % 2], "w " * (5 if t % 2 == 0 else 80)) for c in range(20, 60) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m = chat.fit(df)
    # In pieces, and as a whole.
    out = chat.format_turns(df, m, 100, 300)
    got = {(r.conv_id, r.turn): r.role_pred for r in out.collect()}
    assert len(got) == len(rows)
    assert got == {(r.conv_id, r.turn): r.role_pred for r in chat.format_turns(df, m).collect()}
    for conv in (7, 30):
        mine = sorted(r for r in rows if r[0] == conv)
        path = chat.decode(m, [m.score(*u) for r in mine for u in chat.units(r[3])])
        assert [got[conv, r[1]] for r in mine] == [m.roles[i] for i in path]


def test_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    out = chat.op1_chat_format(spark, "/root/testdata/sf0.01")
    got = out.where("held_out and part = 0").join(truth, ["conv_id", "turn"])
    right, n = got.select(F.avg((F.col("role") == F.col("role_pred")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.9
    assert out.where("part = 0").count() == truth.select("conv_id", "turn", "text").distinct().count()


@pytest.mark.parametrize("role", ["user", None])
def test_edges(spark, role):
    rows = [(1, 0, role, None, "x"), (1, 0, role, None, "x"), (None, 1, role, "", "x"), (2, None, role, "Human: a\nAI: b", "x"), (3, 0, role, "l\n" * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, rendered string")
    out = chat.format_turns(df, chat.fit(df)).collect()
    assert len(out) == 5 and sorted(r.copies for r in out) == [1, 1, 1, 1, 2]
    again = chat.format_turns(df, chat.fit(df), 0, 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    empty = df.limit(0)
    assert chat.format_turns(empty, chat.fit(empty)).count() == 0


def test_fit_against_plain_counts(spark):
    rng = random.Random(23)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["User: a b?", "- x\n- y", "plain " * rng.randint(1, 9), "AI: ok\nUser: why?"])) for c in range(40) for t in range(5)]
    m = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    units, seen = {r: 2 * chat.PRIOR for r in m.roles}, {}
    for _, _, role, text in rows:
        for unit in chat.units(text) if role else []:
            units[role] += 1
            for f in chat.features(*unit):
                seen.setdefault(f, dict.fromkeys(m.roles, chat.PRIOR))[role] += 1
    for role in chat.MARKERS:
        if role in m.roles:
            seen.setdefault(f"marker={role}", dict.fromkeys(m.roles, chat.PRIOR))[role] += chat.SURE
    assert m.emit.keys() == seen.keys()
    for f, by_role in seen.items():
        assert np.allclose(m.emit[f], [np.log(by_role[r] / units[r]) for r in m.roles])
    roles = {(c, t): r for c, t, r, _ in rows if r}
    move = np.full((len(m.roles),) * 2, chat.PRIOR)
    for (c, t), r in roles.items():
        if (c, t - 1) in roles:
            move[m.roles.index(roles[c, t - 1]), m.roles.index(r)] += 1
    assert np.allclose(m.move, np.log(move / move.sum(axis=1, keepdims=True)))
