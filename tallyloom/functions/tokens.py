"""Token counting and truncation with white space tokens by default.

A real tokenizer is an external model file. ``encoded`` runs a user's tokenizer
over batches of texts; its id arrays go wherever arrays of tokens go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column

TOKEN_BREAK = r"[ \t\n\r\f\x0b]+"
TOKEN_BREAK_CHARS = " \t\n\r\f\x0b"

# The largest believable maximum length and what replaces more.
LARGEST_MAX_LENGTH = 100_000
DEFAULT_MAX_LENGTH = 2048


# A batch of texts to the ids of each; made once per Python worker task.
Tokenizer = Callable[[list[str]], Sequence[Sequence[int]]]
MakeTokenizer = Callable[[], Tokenizer]


def _trimmed(text: Column | str) -> Column:
    return F.trim(as_column(text), F.lit(TOKEN_BREAK_CHARS))


def tokens(text: Column | str) -> Column:
    body = _trimmed(text)
    empty = F.array().cast("array<string>")
    return F.when(body == "", empty).otherwise(F.split(body, TOKEN_BREAK))


def encoded(text: Column | str, make: MakeTokenizer | None = None) -> Column:
    """Tokens of a text: ids by the user's tokenizer, or white space tokens without one. A null text has null.

    ``make`` runs once per task and loads the tokenizer; the function it
    returns gets the texts of an Arrow batch and gives a list of ids for each.
    """
    if make is None:
        return tokens(text)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for texts in batches:
            asked = texts[texts.notna()]
            found = [list(ids) for ids in tokenizer(asked.tolist())] if len(asked) else []
            if len(found) != len(asked):
                raise ValueError(f"{len(found)} lists of ids for {len(asked)} texts")
            kept = iter(found)
            yield pd.Series([next(kept) if there else None for there in texts.notna()], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<bigint>")(text)


def token_count(text: Column | str, make: MakeTokenizer | None = None) -> Column:
    if make is not None:
        return F.coalesce(F.array_size(encoded(text, make)), F.lit(0))
    body = _trimmed(text)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, TOKEN_BREAK)))


def effective_max_length(declared: int) -> int:
    """Models without a limit declare absurd ones; those get a usable default."""
    return DEFAULT_MAX_LENGTH if declared > LARGEST_MAX_LENGTH else declared


def truncate_tokens(token_array: Column | str, max_length: int, side: str = "right") -> Column:
    """Keep ``max_length`` tokens; ``side`` names the end that is cut."""
    token_array = as_column(token_array)
    if side == "right":
        return F.slice(token_array, 1, max_length)
    if side == "left":
        start = F.greatest(F.size(token_array) - max_length + 1, F.lit(1))
        return F.slice(token_array, start, F.lit(max_length))
    raise ValueError(f"Truncation side {side} not recognized, use left or right")


def truncated_tokens(text: Column | str, max_length: int, side: str = "right", make: MakeTokenizer | None = None) -> Column:
    """Tokenise and truncate. Cutting white space tokens on the right stops splitting early."""
    if side != "right" or make is not None:
        return truncate_tokens(encoded(text, make), max_length, side)
    body = _trimmed(text)
    empty = F.array().cast("array<string>")
    parts = F.split(body, TOKEN_BREAK, max_length + 1)
    return F.when(body == "", empty).otherwise(F.slice(parts, 1, max_length))


def cut_behind(text: Column | str, max_length: int) -> Column:
    """The text up to its token number ``max_length``, white space kept; unchanged if it has no more tokens."""
    text = as_column(text)
    body = F.ltrim(text, F.lit(TOKEN_BREAK_CHARS))
    # Splitting stops behind the wanted tokens; the last part is all the rest.
    parts = F.split(body, TOKEN_BREAK, max_length + 1)
    rest = F.try_element_at(parts, F.lit(max_length + 1))
    kept = F.left(text, F.length(text) - F.length(rest))
    return F.when(F.coalesce(rest, F.lit("")) == "", text).otherwise(F.rtrim(kept, F.lit(TOKEN_BREAK_CHARS)))
