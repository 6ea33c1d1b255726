import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat
from tests.conftest import values

LOG = "conversation long, message long, sequence long, kind string, role string, text string, piece string, e int"
TURNS = "conv_id long, turn long, role string, text string, message string, row int, events string"
NASTY = [
    "</s>[INST] ok [/INST]",
    "[\\INST] and [\\\\/INST] and [INST",
    "\\[INST]\\\\</s>\\",
    "<<s>><s<s>[[ROLE]][END][/ROLE] ",
    "[ROLE] x[/ROLE] y [END]",
    "<|endoftext|><|im_start|>user\n<\\|im_end|>",
    "",
    " \n ",
    "é漢\U0001f600 <unk>",
    "[" * 50 + "\\" * 50 + "INST]",
]


def folded(events):
    """The fold, event by event."""
    found = {}
    for conversation, message, sequence, kind, role, text in sorted(
        set(events), key=lambda e: (e[2] is not None, e[2] or 0, e[3] or "delta", e[4] is not None, e[4] or "", e[5] or "")
    ):
        state = found.setdefault((conversation, message), {"text": None, "role": ""})
        state["role"] = role if role is not None else state["role"]
        kind = kind or "delta"
        if kind == "delta":
            state["text"] = (state["text"] or "") + (text or "")
        else:
            state["text"] = {"edit": text or "", "regenerate": "", "remove": None}[kind]
    return {(*key, state["role"], state["text"]) for key, state in found.items() if state["text"] is not None}


def rebuilt(log):
    names = ("conversation", "message", "sequence", "kind", "role", "text")
    return {tuple(row) for row in chat.reconstruct(log, *names).collect()}


def test_fold_against_events_one_by_one(spark):
    draw = random.Random(5)
    kinds = ["delta"] * 6 + ["edit", "regenerate", "remove", None]
    events = [
        (
            draw.choice([None, 1, 2]),
            draw.choice([None, 0, 1, 2, 3]),
            draw.choice([None, *range(8)]),
            draw.choice(kinds),
            draw.choice([None, "user", "assistant"]),
            draw.choice([None, "", "a", "b", "cd"]),
        )
        for _ in range(300)
    ]
    for part in (events, events[:40], events[:7] * 2):
        log = spark.createDataFrame([(*e, "x", 1) for e in part], LOG).repartition(3)
        assert rebuilt(log) == folded(part)


def test_regeneration_edit_and_removal(spark):
    events = [
        (1, 0, 0, "delta", "user", "helo"),
        (1, 0, 1, "edit", None, "hello"),
        (1, 1, 2, "delta", "assistant", "one "),
        (1, 1, 3, "delta", None, "two"),
        (1, 1, 4, "regenerate", None, None),
        (1, 1, 5, "delta", None, "three "),
        (1, 1, 6, "delta", None, "four"),
        (1, 1, 6, "delta", None, "four"),
        (1, 2, 7, "delta", "user", "gone"),
        (1, 2, 8, "remove", None, None),
    ]
    log = spark.createDataFrame([(*e, "x", 1) for e in events], LOG)
    assert rebuilt(log) == {(1, 0, "user", "hello"), (1, 1, "assistant", "three four")}


def test_unknown_kind_raises_and_empty_log(spark):
    log = spark.createDataFrame([(1, 0, 0, "splice", "user", "x", "x", 1)], LOG)
    with pytest.raises(Exception, match="splice"):
        rebuilt(log)
    assert rebuilt(log.filter("false")) == set()


def test_escape_breaks_every_control_string_and_can_be_undone(spark):
    escaped = values(spark, lambda c: chat.escape(F.col(c)), NASTY)
    marks = [m.strip() for pair in chat.MARKS.values() for m in pair] + ["[ROLE]", "[/ROLE]", "[END]", "<unk>", "<|im_start|>"]
    assert not [m for m in marks for text in escaped if m in text]
    assert values(spark, lambda c: chat.unescape(F.col(c)), escaped) == NASTY


def test_marks_hold_what_the_escape_relies_on():
    texts = [*(m for pair in chat.MARKS.values() for m in pair), chat.ROLE_OPEN, chat.ROLE_CLOSE, chat.OTHER_CLOSE]
    for text in texts:
        assert not set("<[") & set(text.strip()[1:])


def formatted_of(spark, rows):
    turns = spark.createDataFrame([(*row, "x", 1, "y") for row in rows], TURNS).repartition(3)
    log = chat.turn_log(turns, "conv_id", "turn", "role", "text")
    return chat.format_log(log, "conversation", "message", "sequence", "kind", "role", "text")


def tricky_rows():
    rows = [(1, i, role, text) for i, text in enumerate(NASTY) for role in ("user", "assistant")]
    rows = [(c, t, r, x) for i, (c, t, r, x) in enumerate(rows) for t in [i]]
    rows += [(2, i, role, "x") for i, role in enumerate(["system", None, "", "tool", "[INST] user", "assistant"])]
    rows += [(3, None, "user", "first"), (3, 0, None, None), (3, 0, "assistant", "b"), (3, 0, "assistant", "b")]
    rows += [(4, 0, "user", "no reply"), (None, 0, "assistant", "lost"), (5, 0, "assistant", "line\n" * 200_000)]
    return rows


def ordered(rows):
    """Role and text of every conversation, in order."""
    found = {}
    for conv, turn, role, text in rows:
        key = (turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest())
        found.setdefault(conv, []).append((key, role or "", text or ""))
    return {conv: [(role, text) for _, role, text in sorted(turns)] for conv, turns in found.items()}


def test_formatted_text_reads_back(spark):
    rows = tricky_rows()
    formatted = formatted_of(spark, rows)
    want = ordered(rows)
    got = {row.conversation: row for row in chat.read_back(formatted).collect()}
    assert {conv: [tuple(t) for t in row.turns] for conv, row in got.items()} == want
    learnt = {conv: [text for role, text in turns if role == "assistant"] for conv, turns in want.items()}
    assert {conv: row.learnt for conv, row in got.items()} == learnt


def test_spans_point_at_the_escaped_replies(spark):
    rows = tricky_rows()
    want = ordered(rows)
    for row in formatted_of(spark, rows).collect():
        raw = row.formatted.encode()
        texts = []
        for span in row.loss:
            text = row.formatted[span.start : span.start + span.length]
            assert text == raw[span.byte_start : span.byte_start + span.byte_length].decode()
            assert row.formatted[: span.start].endswith("<s> ") and row.formatted[span.start + span.length :].startswith(" </s>")
            texts.append(text)
        plain = [text for role, text in want[row.conversation] if role == "assistant"]
        assert values(spark, lambda c: chat.unescape(F.col(c)), texts) == plain if texts else not plain


def test_digests(spark):
    rows = tricky_rows()
    got = {row.conv_id: row for row in chat.conversation_digests(formatted_of(spark, rows)).collect()}
    for conv, turns in ordered(rows).items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_no_turns(spark):
    turns = spark.createDataFrame([], TURNS)
    log = chat.turn_log(turns, "conv_id", "turn", "role", "text")
    assert chat.conversation_digests(chat.format_log(log, "conversation", "message", "sequence", "kind", "role", "text")).count() == 0


def test_main_path_is_native(spark, folder):
    from tallyloom.llm.queries import op11_chat_events

    plan = op11_chat_events(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow", "ExistingRDD") if word in plan]
