"""Turn tables: every turn is a row, whatever the length of its conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.template_text import TextTemplate
from ..functions.templates import TASKS, AnyTemplate
from .lookup import lookup


def render_turns(
    turns: DataFrame, conversation: str, turn: str, role: str, content: str, template: AnyTemplate, task: str
) -> DataFrame:
    """Text of every turn: conversation, turn, ``text``; joined in turn order they are the conversation's text.

    The first turn comes with the empty system turn in front unless it is a
    system turn, and for ``generation`` the last one with the opener behind.
    First and last turn come from a narrow aggregate that is looked up again,
    so no task holds a conversation. A turn without a conversation or a number
    is rendered by itself.
    """
    if task not in TASKS:
        raise ValueError(f"{task!r} is no task to render for; there are {', '.join(TASKS)}")
    rows = turns.select(
        F.col(conversation),
        F.col(turn),
        F.coalesce(role, F.lit("")).alias("__role"),
        F.coalesce(content, F.lit("")).alias("__content"),
    )
    ends = turns.groupBy(conversation).agg(F.min(turn).alias("__first"), F.max(turn).alias("__last"))
    found = lookup(rows, ends, [conversation], [turn], "left")
    opens = (F.col(turn) == F.col("__first")) & (F.col("__role") != "system")
    if isinstance(template, TextTemplate):
        return found.select(conversation, turn, _compiled(template, turn, opens, task).alias("text"))
    text = F.concat(
        F.when(opens, template.turn(F.lit("system"), F.lit(""))).otherwise(F.lit("")),
        template.turn(F.col("__role"), F.col("__content")),
    )
    if task == "generation":
        closes = F.col(turn) == F.col("__last")
        text = F.concat(text, F.when(closes, template.opener(F.col("__role"))).otherwise(F.lit("")))
    return found.select(conversation, turn, text.alias("text"))


def _compiled(template: TextTemplate, turn: str, opens: Column, task: str) -> Column:
    """Text of a turn by a compiled template; an added system turn is then the first one."""
    generation = task == "generation"
    first = F.coalesce((F.col(turn) == F.col("__first")) & ~opens, F.lit(False))
    last = F.coalesce(F.col(turn) == F.col("__last"), F.lit(False))
    added = template.turn_text(F.lit("system"), F.lit(""), F.lit(True), F.lit(False), generation)
    own = template.turn_text(F.col("__role"), F.col("__content"), first, last, generation)
    return F.concat(F.when(opens, added).otherwise(F.lit("")), own)


def first_turns(turns: DataFrame, conversation: str, turn: str, role: str, content: str, k: int) -> DataFrame:
    """The first ``k`` turns of every conversation as ``messages``; cut before they are shuffled."""
    order = Window.partitionBy(conversation).orderBy(turn)
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    kept = turns.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= k)
    grouped = kept.groupBy(conversation).agg(F.array_sort(F.collect_list(entry)).alias("__entries"))
    messages = F.transform("__entries", lambda e: F.struct(e["role"], e["content"]))
    return grouped.select(conversation, messages.alias("messages"))


def user_turns(turns: DataFrame, conversation: str, role: str) -> DataFrame:
    """How many turns of a conversation do not count towards the loss: ``n_masked`` of ``n_turns``."""
    return turns.groupBy(conversation).agg(
        F.count_if(F.col(role) == "user").alias("n_masked"), F.count(F.lit(1)).alias("n_turns")
    )
