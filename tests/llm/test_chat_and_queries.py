"""Chat formatting, the registered queries against SQL, and the pipeline against a plain version."""

import math
import os

import duckdb
import pytest

from graphweft.llm import chat_format as chat

from .helpers import DATA, needs_data


def conversations(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "conv_id long, turn long, role string, text string, turns string, c string")


def pair(spark, rows, a=0, b=1):
    p = spark.createDataFrame([(1, a, b)], "pair_id long, chosen_id long, rejected_id long")
    return chat.preference_pairs(conversations(spark, rows), p).first()


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_common_prefix_and_masks(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "bäd")]
    r = pair(spark, rows)
    assert r.prompt == turn("user", "hi") and r.n_prompt_turns == 1
    assert r.chosen == turn("assistant", "good") + turn("user", "ok") and r.rejected == turn("assistant", "bäd")
    s, e = map(int, r.chosen_mask.split(":"))
    assert r.chosen[s:e] == "good<|im_end|>"
    s, e = map(int, r.rejected_mask.split(":"))
    assert r.rejected[s:e] == "bäd<|im_end|>"


def test_turn_order_equal_conversations_and_gaps(spark):
    rows = [(0, 1, "assistant", "b"), (0, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    r = pair(spark, rows)
    assert (r.n_prompt_turns, r.chosen, r.rejected, r.chosen_mask) == (2, "", "", "")
    r = pair(spark, rows[:2])
    assert r.n_prompt_turns == 0 and r.rejected == "" and r.chosen == turn("user", "a") + turn("assistant", "b")


def test_odd_turns(spark):
    rows = [(0, None, None, None), (0, 0, "user", "<|im_end|> \U0001f600"), (0, 0, "user", "<|im_end|> \U0001f600"), (1, None, None, None), (1, 0, "assistant", "x" * 100_000), (None, 0, "user", "lost")]
    r = pair(spark, rows)
    assert r.n_prompt_turns == 1 and r.prompt == turn("", "") and r.chosen == turn("user", "< |im_end|> \U0001f600") * 2
    s, e = map(int, r.rejected_mask.split(":"))
    assert r.rejected[s:e] == "x" * 100_000 + "<|im_end|>"
    c = conversations(spark, [])
    assert chat.preference_pairs(c, chat.adjacent_pairs(c)).count() == 0


def test_native_plan(spark):
    c = conversations(spark, [(0, 0, "user", "a")])
    plan = chat.preference_pairs(c, chat.adjacent_pairs(c))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian"))


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if type(v).__name__ in ("float", "Decimal") else repr(v)


@needs_data
@pytest.mark.parametrize("name", ["op4_embedding_near_dedup", "op5_chat_formatting", "op6_mixing", "op8_line_dedup", "op10_decontamination"])
def test_against_sql(spark, name):
    from graphweft.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.sql(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    df, expected = QUERIES[name](spark, DATA), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in expected.fetchall())


@needs_data
def test_all_are_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
