import random

import pytest

from tallyloom.functions.templates import CHATML, PROBLEM_SOLUTION, chat_text
from tallyloom.operators import lookup as lookup_module
from tallyloom.operators.conversations import first_turns, render_turns, user_turns
from tallyloom.plans.calibration import calibration_turns

SCHEMA = "conv long, turn long, role string, text string"


def table():
    # Numbers on both sides of 1024, a gap, negative numbers, a long and some short conversations.
    turns = [(0, t, ["user", "assistant"][t % 2], f"t{t}") for t in range(1, 2500)]
    turns += [(1, 1023, "user", "a"), (1, 1024, "assistant", "b")]
    turns += [(2, -5, "system", "s"), (2, 7, "user", "u"), (2, 5000, "assistant", None)]
    turns += [(3, 4, "user", "only")]
    return turns


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("template", [CHATML, PROBLEM_SOLUTION])
@pytest.mark.parametrize("task", ["sft", "generation"])
def test_turns_join_to_the_text_of_the_whole_conversation(spark, monkeypatch, template, task, small):
    if not small:
        monkeypatch.setattr(lookup_module.lookup, "__defaults__", ("inner", 1, 50))
    turns = table()
    random.Random(1).shuffle(turns)
    rows = spark.createDataFrame(turns, SCHEMA).repartition(5)
    found = render_turns(rows, "conv", "turn", "role", "text", template, task).collect()
    assert len(found) == len(turns)
    shown = {}
    for row in sorted(found):
        shown[row.conv] = shown.get(row.conv, "") + row.text
    arrays = {}
    for conv, _, role, text in sorted(turns, key=lambda t: t[:2]):
        arrays.setdefault(conv, []).append((role, text))
    whole = spark.createDataFrame(list(arrays.items()), "conv long, messages array<struct<role:string,content:string>>")
    expected = whole.select("conv", chat_text("messages", template, task).alias("text")).collect()
    assert shown == {row.conv: row.text for row in expected}


def test_turns_without_conversation_and_unknown_tasks(spark):
    rows = spark.createDataFrame([(None, 1, "user", "x"), (1, None, "user", "y")], SCHEMA)
    texts = {row.text for row in render_turns(rows, "conv", "turn", "role", "text", PROBLEM_SOLUTION, "sft").collect()}
    assert texts == {"### Problem: x\n", "### Problem: y\n"}
    with pytest.raises(ValueError, match="no task"):
        render_turns(rows, "conv", "turn", "role", "text", PROBLEM_SOLUTION, "other")


def test_first_turns_go_by_position(spark):
    rows = spark.createDataFrame(table(), SCHEMA)
    found = {row.conv: [m.content for m in row.messages] for row in first_turns(rows, "conv", "turn", "role", "text", 2).collect()}
    assert found == {0: ["t1", "t2"], 1: ["a", "b"], 2: ["s", "u"], 3: ["only"]}
    texts = {row.conv: row.text for row in calibration_turns(rows, "conv", "turn", "role", "text").collect()}
    assert texts[1] == "### Problem: a\n### Solution: b\n" and texts[3] == "### Problem: only\n### Solution: \n"
    counts = {row.conv: (row.n_masked, row.n_turns) for row in user_turns(rows, "conv", "role").collect()}
    assert counts[0] == (1249, 2499) and counts[2] == (1, 3)
