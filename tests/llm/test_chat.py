import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import chat_format as chat

SCHEMA = "conv_id long, turn long, text string"


def read(spark, rows, p=None):
    found = chat.chat_turns(spark.createDataFrame(rows, SCHEMA), p).collect()
    return [(r.conv_id, r.turn, r.part, r.role, r.text) for r in sorted(found, key=lambda r: (r.conv_id, r.turn, r.part))]


def brute(lines, p):
    """The best of all paths, one by one."""
    best, path = -np.inf, None
    for states in itertools.product(range(chat.STATES), repeat=len(lines)):
        score, last = 0.0, None
        for line, s in zip(lines, states, strict=True):
            score += p.tables["start"][s] if last is None else p.tables["moves"][line.fresh][last][s]
            score += p.tables["emit"][line.role, line.kind, line.rest_kind][s]
            last = s
        if score > best:
            best, path = score, states
    return best, path


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_equals_all_paths(seed):
    rng = random.Random(seed)
    pieces = ["User: why?", "A: red", "plain words", "", "### Human:", "- item", "[TOOL] 5", "tool", "System: x", "what?"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(n)) for n in ((2, 2), (3, 1), (4,))[seed % 3]]
    p = chat.Parameters(marked=0.6, stray=0.1, wrong=0.1)
    lines = chat._lines(texts)
    assert tuple(chat.viterbi(lines, p)) == brute(lines, p)[1]
    # blocks that are chained by their products have the same best score
    half = len(lines) // 2
    whole = chat.transfer(lines[:half], p, True)[0][:, None] + chat.transfer(lines[half:], p, False)
    assert whole.max() == pytest.approx(brute(lines, p)[0])


def test_round_trip_with_missing_markers(spark):
    texts = [f"hello {{}}?", "", "two\nlines", "\nlead and end\n", None]
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 2 else 1 + (t + c) % 2], texts[(c + t) % 5]) for c in range(40) for t in range(7)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    p = chat.fit(turns)
    got = sorted((r.conv_id, r.turn, r.role, r.text, r.rendered) for r in chat.chat_turns(chat.as_transcripts(turns), p).collect())
    assert [g[:4] for g in got] == [(c, t, r, x or "") for c, t, r, x in rows]
    assert got[0][4] == chat.render(got[0][2], got[0][3])
    assert p.follows[1][2] > 0.9 and sum(p.first) == pytest.approx(1) and all(sum(x) == pytest.approx(1) for x in (*p.follows, *p.classes))


def test_several_turns_in_one_text(spark):
    text = "User: hi there?\nAssistant: hello\nmore of it\nUser: and now?\n[TOOL] result 5\nAI: five"
    got = read(spark, [(1, 0, text), (2, 0, "Human: a question?"), (2, 1, "an answer without a marker"), (2, 2, "Human: thanks")])
    assert got == [
        (1, 0, 0, "user", "hi there?"), (1, 0, 1, "assistant", "hello\nmore of it"), (1, 0, 2, "user", "and now?"), (1, 0, 3, "tool", "result 5"), (1, 0, 4, "assistant", "five"),
        (2, 0, 0, "user", "a question?"), (2, 1, 0, "assistant", "an answer without a marker"), (2, 2, 0, "user", "thanks"),
    ]


def test_the_model_overrules_markers(spark):
    p = chat.Parameters(goes_on=0.8, stray=0.02, follows=((0.01, 0.9, 0.08, 0.01), (0.001, 0.001, 0.997, 0.001), (0.001, 0.997, 0.001, 0.001), (0.01, 0.05, 0.9, 0.04)))
    # a line that looks like a marker inside an answer is text, and stays byte for byte
    menu = "Assistant: Options:\nA: red\nB: blue\n  a:  kept "
    assert read(spark, [(1, 0, "User: which?"), (1, 1, menu), (1, 2, "User: red")], p) == [(1, 0, 0, "user", "which?"), (1, 1, 0, "assistant", menu[11:]), (1, 2, 0, "user", "red")]
    # a marker that names the wrong role is a marker all the same
    got = read(spark, [(1, 0, "User: a?"), (1, 1, "Bot: b"), (1, 2, "Bot: c?"), (1, 3, "Bot: d"), (1, 4, "User: e?")], p)
    assert [(g[3], g[4]) for g in got] == [("user", "a?"), ("assistant", "b"), ("user", "c?"), ("assistant", "d"), ("user", "e?")]


def test_other_names_are_text(spark):
    got = read(spark, [(1, 0, "User: hi\n[MODERATOR] quiet\nNote: a: b")])
    assert got == [(1, 0, 0, "user", "hi\n[MODERATOR] quiet\nNote: a: b")]


def damaged(seed=3, n=300):
    """(rows, truth by row): transcripts with markers that are missing, wrong, or stray."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for c in range(n):
        role = "user"
        for t in range(rng.randint(3, 9)):
            if role == "user":
                text = rng.choice(["why is it so?", "and what then?", "tell me more\nplease?", "is that all?"])
            else:
                text = rng.choice(["because of this\n- one\n- two", "it is a long story " * 20, "1. first\n2. second\nAnswer: so it is", "no more to say\nthan this"])
            shown = role if rng.random() > 0.03 else "system"
            rows.append((c, t, text if rng.random() < 0.2 else f"{shown.title()}: {text}"))
            truth[c, t] = role
            role = "assistant" if role == "user" else "user"
    return rows, truth


def test_parameters_learned_without_roles(spark):
    rows, truth = damaged()
    p = chat.learn(spark.createDataFrame(rows, SCHEMA))
    assert 0.6 < p.marked < 0.95 and p.breaks > 0.9 and p.follows[1][2] > 0.9
    assert p.classes[1][1] > 0.5 > p.classes[2][1]  # users ask
    fresh, truth = damaged(4)
    first = {}
    for c, t, _, role, _ in read(spark, fresh, p):
        first.setdefault((c, t), role)
    assert sum(first[k] == truth[k] for k in truth) / len(truth) > 0.95  # markers alone: 0.78


def test_learning_keeps_its_shape_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat.learn(none).marked == pytest.approx(0.9)
    empty = chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert np.allclose(empty.follows, chat.Parameters().follows) and np.allclose(empty.classes, chat.Parameters().classes)


def test_line_classes_are_counted(spark):
    turns = spark.createDataFrame([(1, 0, "user", "why?\nwhy?"), (1, 1, "assistant", "- a\n- b"), (1, 2, "other", "x"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    p = chat.fit(turns)
    assert p.classes[1][1] > chat.Parameters().classes[1][1] and p.classes[2][2] > chat.Parameters().classes[2][2]


def test_long_conversation_in_blocks(spark, monkeypatch):
    rows = [(7, t, ("User: " if t % 4 == 0 else "Bot: " if t % 4 == 2 else "") + f"line {t}" + ("?" if t % 3 else "")) for t in range(100)]
    df = spark.createDataFrame([*rows, (8, 0, "User: x"), (None, None, None)], SCHEMA)
    whole = sorted(map(str, chat.chat_turns(df).collect()))
    monkeypatch.setattr(chat, "BLOCK", 9)
    assert sorted(map(str, chat.chat_turns(df).collect())) == whole
    assert chat.chat_turns(df.where("false")).count() == 0


def test_rows_with_equal_or_no_numbers_spread_over_blocks(spark, monkeypatch):
    rows = [(1, None, f"User: n{i}?") for i in range(60)] + [(1, 4, f"Bot: b{i}\nand more") for i in range(60)] + [(1, i, f"User: u{i}?") for i in range(12)] + [(2, None, "x"), (None, None, "User: y")]
    df, p = spark.createDataFrame(rows, SCHEMA), chat.Parameters(wrong=1e-4)  # else there are ties
    whole = sorted(map(str, chat.chat_turns(df, p).collect()))
    monkeypatch.setattr(chat, "BLOCK", 8)
    blocks = chat._blocks(df.select("conv_id", "turn", "text"))
    assert blocks.groupBy("conv_id", "b", "sub").count().agg(F.max("count")).first()[0] < 25
    assert sorted(map(str, chat.chat_turns(df, p).collect())) == whole


def test_codes_say_all_that_the_model_sees():
    lines = chat._lines(["User: why?\n- item\n\n[TOOL] 5", "### Human:\nplain " + "long " * 60, ""])
    got = chat._decoded(np.array([chat._code(x) for x in lines], "<u2").tobytes())
    assert [(x.role, x.kind, x.rest_kind, x.fresh) for x in got] == [(x.role, x.kind, x.rest_kind, x.fresh) for x in lines]


def test_learning_counts_every_conversation(spark):
    """More conversations than 2000, one of several blocks and one without an id: all lines of all of them count."""
    rows = [(c, t, ["User: a question?", "plain"][t % 2] if c % 3 else f"[TOOL] {t}") for c in range(2500) for t in range(2)]
    rows += [(9999, t, ["Human: more?", "- item", "AI: yes"][t % 3]) for t in range(2 * chat.BLOCK + 7)]
    rows += [(None, t, "System: rules") for t in range(3)]
    p, by_conv = chat.Parameters(), {}
    for c, t, x in rows:
        by_conv.setdefault(c, []).append(x)
    total = chat._Counts()
    for texts in by_conv.values():
        lines = chat._lines(texts)
        total.add(lines, chat.viterbi(lines, p).tolist())
    want, got = total.parameters(p), chat.learn(spark.createDataFrame(rows, SCHEMA), p, rounds=1)
    for name in ("marked", "stray", "wrong", "goes_on", "breaks", "first", "follows", "classes"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-12), name
