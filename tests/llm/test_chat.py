from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from glyco.llm import chat

HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\\\s \\l \\h \\c", "", "Ünï 😀 # < : \\", "\n\n", "ends with \\"]
TURNS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, TURNS))
    return {
        r.conv_id: r
        for r in out.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    }


def test_round_trip_of_control_strings(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate((r, t) for t in HARD for r in ("user", "assistant", "odd: #role<"))]
    got = formatted(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]
    assert got.loss == "".join(t for _, _, r, t in rows if r == "assistant")
    assert got.formatted.count("</turn>") == len(rows)
    assert all("#" not in got.formatted[s.start : s.end] for s in got.loss_spans)


def test_ties_nulls_and_repeated_rows(spark):
    long_text = "word " * 200_000
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (1, 0, "a", "y"), (1, None, None, None), (None, 3, "user", "z"), (2, 0, "assistant", long_text)]
    got = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("a", "y"), ("a", "y"), ("b", "x"), ("", "")]
    assert [t.text for t in got[None].turns] == ["z"] and got[None].loss == ""
    assert got[2].loss == long_text
    assert formatted(spark, []) == {}


def test_layouts_are_told_apart_by_fingerprint(spark):
    tables = {
        "rows": spark.createDataFrame([(1, 0, "user", "q", "en"), (1, 1, "assistant", "a", "en")], TURNS + ", lang string"),
        "messages": spark.createDataFrame([(1, [("user", "q"), ("bot", "a")])], "conv_id long, messages array<struct<role string, content string>>"),
        "from": spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from string, value string>>"),
        "prompt": spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        "instruction": spark.createDataFrame([(1, "q", "a")], "conv_id long, instruction string, output string"),
        "input": spark.createDataFrame([(1, "q", None, "a")], "conv_id long, instruction string, input string, output string"),
    }
    for table in tables.values():
        got = sorted((r.turn, r.role, r.text) for r in chat.canonical(table).collect())
        assert [(r, t) for _, r, t in got] == [("user", "q"), ("assistant", "a")]
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id long, story string"))


def test_extra_columns_of_other_layouts_change_nothing(spark):
    """Turn rows stay turn rows beside columns that other layouts name."""
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    want = sorted(tuple(r) for r in chat.canonical(rows).collect())
    for extra in (["system"], ["prompt"], ["input"], ["messages"], ["prompt", "response", "system"], ["instruction", "output", "input", "value"]):
        wide = rows.withColumns({c: F.lit("x") for c in extra})
        assert sorted(tuple(r) for r in chat.canonical(wide).collect()) == want
    nested = rows.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("no").alias("content"))))
    assert sorted(tuple(r) for r in chat.canonical(nested).collect()) == want
    prompt = spark.createDataFrame([(1, "q", "a", "s", "w")], "conv_id long, prompt string, response string, system string, turn string")
    assert [r.role for r in chat.canonical(prompt).orderBy("turn").collect()] == ["system", "user", "assistant"]


def test_json_records_may_mix_layouts(spark):
    records = [
        json.dumps({"conv_id": 1, "messages": [{"role": "user", "content": "q1"}, {"role": "assistant", "content": "a1"}]}),
        json.dumps({"conv_id": 2, "prompt": "q2", "response": "a2"}),
        json.dumps({"conv_id": 3, "instruction": "do", "input": "it", "output": "done"}),
        json.dumps({"conv_id": 4, "conversations": [{"from": "human", "value": "q4"}, {"from": "gpt", "value": "a4"}]}),
        json.dumps({"conv_id": 5, "novel": 1}),
        "not json",
        None,
    ]
    turns, unknown = chat.canonical_json(spark.createDataFrame([(r,) for r in records], "record string"), "record")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in turns.collect())
    assert [(c, r, t) for c, _, r, t in got] == [
        (1, "user", "q1"), (1, "assistant", "a1"), (2, "user", "q2"), (2, "assistant", "a2"),
        (3, "user", "do\nit"), (3, "assistant", "done"), (4, "user", "q4"), (4, "assistant", "a4"),
    ]
    assert sorted(map(str, (r.record for r in unknown.collect()))) == sorted(map(str, records[4:]))


def test_query_holds_the_control_conversation(spark):
    from glyco.llm.queries import CONTROL_TEXT, QUERIES

    row = QUERIES["op2_format_chats"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(CONTROL_TEXT)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(CONTROL_TEXT.encode()).hexdigest()
