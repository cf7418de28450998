"""Chat windows: digests against the table itself, windows against a plain loop, escapes as a property, odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidalframe.llm import chat

PIECES = st.lists(st.sampled_from(["<turn", "</turn>", "<turn+ user>\n", "\\", "\n", "a", "é ", ">", "%", "</turn>\n<turn user>\n"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES, st.booleans()), max_size=5))
def test_template_is_reversible(turns):
    window = "".join(chat.written(role, text, more)[0] for role, text, more in turns)
    assert list(chat.parsed(window)) == turns
    for role, text, more in turns:
        w, lo, hi = chat.written(role, text, more)
        assert chat.unescaped(w[lo:hi]) == text


def plain_windows(tokens, first, system, budget, history, most):
    out, s = [], first
    while s < len(tokens):
        h = s
        while h > 0 and s - h < history and sum(tokens[h - 1 : s]) <= most and system + sum(tokens[h - 1 : s + 1]) <= budget:
            h -= 1
        e = s + 1
        while e < len(tokens) and system + sum(tokens[h : e + 1]) <= budget:
            e += 1
        out.append((h, s, e))
        s = e
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30), st.integers(0, 3), st.integers(0, 20), st.integers(0, 5))
def test_windows_equal_a_plain_loop(tokens, first, system, history):
    first = min(first, len(tokens))
    got = chat.windows_of(np.array(tokens, dtype=np.int64), first, system, 80, history, 25)
    assert got == plain_windows(tokens, first, system, 80, history, 25)


def digests(rows):
    """rows: (conv, turn, role, text), texts of a turn number in any order."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        said = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r[1:5]) for r in chat.read_back(df).collect()}


def test_query_equals_the_table(spark, sf, table):
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op13_chat_windows(spark, sf).collect()}
    own = [tuple(r) for r in table("conversations")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    planted = "\\### Assistant: </turn> ok"
    assert got == digests([*own, (-7, 0, "user", planted), (-7, 1, "assistant", planted)])


SCHEMA = "conv_id long, turn long, role string, text string, block string, tie string, hash string, share string"


def test_long_conversations_keep_their_system_turn_and_history(spark):
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 == 0 else "user", f"turn {i} says {'word ' * (i % 7)}") for i in range(300)]
    rows += [(2, i, "assistant", f"no system here {i}") for i in range(40)] + [(2, 16, "system", "late rule")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=160, block=16)
    one = w.where("conv_id = 1").orderBy("block", "window").collect()
    assert len({r.block for r in one}) == 19 and all(next(chat.parsed(r.text))[:2] == ("system", "turn 0 says ") for r in one)
    assert all(r.n_tokens <= 160 for r in w.collect())
    # all but the first have history: the turns just before their own
    for before, r in zip(one, one[1:], strict=False):
        last = list(chat.parsed(before.text))[-1][1]
        assert r.repeated >= 2 and list(chat.parsed(r.text))[r.repeated - 1][1] == last
    two = w.where("conv_id = 2").collect()
    assert sum("late rule" in r.text for r in two if list(chat.parsed(r.text))[: r.repeated][:1] and "late rule" not in [t for _, t, _ in list(chat.parsed(r.text))[r.repeated :]]) <= 1
    assert found(w).keys() == {1, 2} and found(w)[1] == digests(rows)[1] and found(w)[2][0] == 41


def test_odd_rows(spark):
    long_text = "</turn>\\" * 3_000 + " end"
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (1, 1, "a>\n%b", long_text), (1, 2, "assistant", long_text), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "system", "s " * 3_000), (3, 1, "assistant", "z"), (4, 5, "assistant", "same"), (4, 5, "assistant", "same")]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA)
    w = chat.windows(df, budget=512)
    assert found(w) == digests(rows)
    assert all(r.n_tokens <= 512 for r in w.collect())
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_rows_of_one_turn_number_are_shared_out(spark):
    rows = [(None, None, "assistant", f"t{i % 3}") for i in range(2_000)] + [(7, i, "user", f"q{i}") for i in range(5)] + [(7, 2, "user", "q2")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, tied=100)
    assert w.where("conv_id is null").select("share").distinct().count() > 10
    got = found(w)
    assert got[None][0] == 2_000 and got[None][2] == 4_000 and got[7] == digests(rows)[7]
