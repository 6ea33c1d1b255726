"""Options a training set can declare: lengths, prefixes, validation share, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..functions.digests import digest_share, seeded_digest
from ..functions.tokens import cut_behind, token_count
from .order import first_rows

# Defaults of the declared options.
VALIDATION_PERCENT = 5
MAX_SOURCE_TOKENS = 128
MAX_TARGET_TOKENS = 128


def with_validation_split(df: DataFrame, key: str, percent: float = VALIDATION_PERCENT, seed: int = 42) -> DataFrame:
    """Add ``split``: about ``percent`` of the rows are set aside for validation."""
    held_out = digest_share(seeded_digest(seed, key)) < percent / 100
    return df.withColumn("split", F.when(held_out, "validation").otherwise("train"))


def shorter_than(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    return df.filter(token_count(text) < max_tokens)


def prediction_rows(df: DataFrame, order: Sequence[str], max_rows: int | None) -> DataFrame:
    return df if max_rows is None else first_rows(df, order, max_rows)


def pair_columns(
    df: DataFrame,
    prompt: str,
    completion: str,
    source_prefix: str = "",
    max_source: int | None = None,
    max_target: int | None = None,
) -> DataFrame:
    """Rename to ``prompt`` and ``completion``, put the prefix first, cut where a length is given.

    Training sets that declare lengths use ``MAX_SOURCE_TOKENS`` and
    ``MAX_TARGET_TOKENS``. What stays of a text stays as it was written.
    """
    source = F.concat(F.lit(source_prefix), as_column(prompt))
    target = as_column(completion)
    return df.withColumns(
        {
            "prompt": source if max_source is None else cut_behind(source, max_source),
            "completion": target if max_target is None else cut_behind(target, max_target),
        }
    )


def mask_user_turns(messages: Column | str) -> Column:
    """Flag the turns that must not count towards the training loss."""
    return F.transform(
        as_column(messages),
        lambda m: F.struct(m["role"], m["content"], (m["role"] == "user").alias("masked")),
    )
