"""Chat formatting: exact round trips, the state machine, the loss mask."""

import hashlib

import duckdb
from cases import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replipulse.llm import chat, queries
from replipulse.llm.twins import TWINS

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 2, "user", None),
    (1, 3, "assistant", "\\<|\\n\\\\|<"), (2, 0, "assistant", "first"), (2, 1, None, "who"), (2, 2, "tool\n<|", "x"),
    (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, "system", "s"), (4, 0, "user", ""),
    (None, 0, "user", "n"), (None, 1, "assistant", "m"), (5, 0, "user", "long " * 30000), (5, 1, "assistant", "é🎉<"),
    (6, 0, "a\\n\\\n", "\n\n"), (7, 0, "user", "only"),
]


def plain(turns):
    chats = {}
    for conv, turn, role, text in turns:
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = []
    for conv, given_turns in chats.items():
        said = [(r, t) for _, _, r, t in sorted(given_turns)]
        whole = "".join(f"{r}\n{t}\n" for r, t in said)
        loss = "".join(t for r, t in said if r == "assistant")
        state, error = "start", -1
        for i, (role, _) in enumerate(said):
            after = chat.CHAT.next.get((state, role))
            error = i if after is None and error < 0 else error
            state = after or state
        found.append((
            conv, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), error < 0 and state == "assistant",
        ))
    return sorted(found, key=repr)


def test_awkward_rows(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)

    def found(turns):
        return rows(chat.digest(chat.format_chats(turns)).drop("formatted_chars"))

    assert found(df) == plain(TURNS)
    clash = df.select("*", *[F.lit("c").alias(n) for n in ("id", "turns", "TEXT", "segments", "check")])
    assert found(clash) == plain(TURNS)
    assert found(df.limit(0)) == []


def test_segments_join_to_the_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<|b")], SCHEMA)
    (row,) = chat.format_chats(df).collect()
    assert "".join(s.text for s in row.segments) == (
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<\\|b<|im_end|>\n"
    )
    assert [s.text for s in row.segments if s.loss] == ["a<\\|b"]


@given(st.lists(st.text("ab\\<|>n\n\r", max_size=12), min_size=1, max_size=40))
@settings(max_examples=15, deadline=None)
def test_escapes_are_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(
        "t",
        chat.escaped(F.col("t")).alias("e"),
        chat.unescaped(chat.escaped(F.col("t"))).alias("u"),
        chat.escaped_role(F.col("t")).alias("er"),
        chat.unescaped_role(chat.escaped_role(F.col("t"))).alias("ur"),
    ).collect():
        assert r.u == r.t == r.ur
        assert "<|" not in r.e and "<|" not in r.er and "\n" not in r.er


def test_error_turns(spark):
    got = {r.conv_id: (r.valid, r.error_turn) for r in chat.format_chats(spark.createDataFrame(TURNS, SCHEMA)).collect()}
    assert got[1] == (True, -1) and got[2] == (False, 0) and got[3] == (False, 1) and got[7] == (False, -1)


def test_query_equals_its_twin(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    got = queries.op7_chat_format(spark, sf_dir)
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({TWINS['op7_chat_format']})").fetchall()
    assert rows(got) == sorted(theirs, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
