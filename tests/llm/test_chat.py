"""Folded events, exact round trips, and the query's SQL."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import compare, database
from millrace.llm import chat, oracles, queries

SF = "/root/testdata/sf0.001"
EVENTS = "conv_id long, seq long, message_id string, kind string, role string, text string"


def read(df):
    rows = df.select("conv_id", chat.read_back(F.col("formatted"), F.col("loss")).alias("t")).collect()
    return {r.conv_id: [(t.role, t.text, t.loss) for t in r.t] for r in rows}


def test_fold(spark):
    rows = [
        (1, 5, "b", "delta", None, "two"), (1, 4, "b", "delta", None, "one "), (1, 3, "b", "regenerate", None, None), (1, 2, "b", "delta", None, "old"),
        (1, 1, "b", "open", "assistant", None), (1, 0, "a", "open", "user", "ignored"), (1, 6, "a", "edit", None, "new "), (1, 7, "a", "delta", None, "end"),
        (1, 0, "a", "delta", None, "before"), (1, 8, "c", "open", "user", None), (1, 9, "c", "delta", None, "x"), (1, 10, "c", "delete", None, None),
        (2, None, "z", "delta", None, "no role"), (None, 1, "q", "open", "assistant", None), (None, 2, "q", "delta", None, None),
    ]
    got = read(chat.format_conversations(spark.createDataFrame(rows, EVENTS)))
    assert got == {1: [("user", "new end", False), ("assistant", "one two", True)], 2: [("", "no role", False)], None: [("assistant", "", True)]}


CONTROL = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "a", "\n", "é", "$1"]), max_size=8).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(CONTROL, CONTROL), min_size=30, max_size=60))
def test_escapes_round_trip(spark, turns):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [t[:2] for t in read(chat.format_conversations(log))[1]] == turns


def test_rows(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "tie"), (1, None, None, None), (2, 3, "assistant", "x" * 200_000), (None, 1, "user", "n")]
    rows += [(3, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(3000)]
    log = chat.as_events(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string"))
    got = read(chat.format_conversations(log))
    assert got[1] == [("", "", False), ("assistant", "tie", True), ("user", "same", False), ("user", "same", False)]
    assert got[2] == [("assistant", "x" * 200_000, True)] and got[None] == [("user", "n", False)]
    assert [t[1] for t in got[3]] == [f"t{t}" for t in range(3000)]


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], EVENTS)).collect() == []


def test_query(spark):
    line = compare(spark, database(SF), SF, "op8_chat", queries.Q["op8_chat"], oracles.SQL["op8_chat"])
    assert line.startswith("OK"), line
