"""Validation problems in, predicted answers out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_class
from ..functions.digests import seeded_digest
from ..functions.templates import PROBLEM_SOLUTION, Template, prompt_text

# Fixed value: the answer column of a problem nobody has answered yet.
UNANSWERED = -1


def validation_problems(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Move the known answer to ``ground_truth`` (0..999) and hide it."""
    return df.withColumn("ground_truth", answer_class(answer)).withColumn("answer", F.lit(UNANSWERED))


def problem_feed(
    problems: DataFrame,
    key: str = "id",
    seed: int | None = None,
    template: Template = PROBLEM_SOLUTION,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Key, problem and prompt of all problems at once, and the columns of ``keep``.

    ``seed`` adds the column ``digest``; sort by it to get them shuffled.
    """
    feed = problems.select(key, "problem", *keep).withColumn("text", prompt_text("problem", template))
    return feed if seed is None else feed.withColumn("digest", seeded_digest(seed, key))


def write_predictions(votes: DataFrame, path: str, key: str = "id", answer: str = "answer") -> None:
    votes.select(F.col(key), F.col(answer).alias("answer")).write.mode("overwrite").parquet(path)
