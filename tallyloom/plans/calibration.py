"""The calibration sample: shuffled prefix, rendered and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import seeded_digest
from ..functions.templates import PROBLEM_SOLUTION, Template, calibration_text
from ..functions.tokens import MakeTokenizer, token_count
from ..operators.conversations import first_turns
from ..operators.order import first_by_digest

# Rows of the sample and seed of its shuffle.
CALIBRATION_ROWS = 256
CALIBRATION_SEED = 42


def _rendered(drawn: DataFrame, template: Template, make: MakeTokenizer | None) -> DataFrame:
    return drawn.withColumn("text", calibration_text("problem", "messages", template)).withColumn(
        "n_tokens", token_count("text", make)
    )


def calibration_sample(
    df: DataFrame,
    key: str,
    rows: int = CALIBRATION_ROWS,
    seed: int = CALIBRATION_SEED,
    template: Template = PROBLEM_SOLUTION,
    make: MakeTokenizer | None = None,
) -> DataFrame:
    """``df`` needs ``problem`` and ``messages``; adds ``text`` and ``n_tokens``, counted by a user's tokenizer if there is one."""
    return _rendered(first_by_digest(df, seeded_digest(seed, key), [key], rows), template, make)


def calibration_turns(
    turns: DataFrame,
    conversation: str,
    turn: str,
    role: str,
    content: str,
    rows: int = CALIBRATION_ROWS,
    seed: int = CALIBRATION_SEED,
    template: Template = PROBLEM_SOLUTION,
    make: MakeTokenizer | None = None,
) -> DataFrame:
    """The same from a turn table: the first turn is the problem, the second its solution.

    Conversations are drawn by their keys; only the turns of the drawn ones,
    at most ``rows`` keys, are read further.
    """
    keys = turns.select(conversation).distinct()
    drawn = first_by_digest(keys, seeded_digest(seed, conversation), [conversation], rows).select(conversation)
    own = turns.join(F.broadcast(drawn), conversation)
    pairs = first_turns(own, conversation, turn, role, content, 2)
    return _rendered(pairs.withColumn("problem", F.get("messages", F.lit(0))["content"]), template, make)
