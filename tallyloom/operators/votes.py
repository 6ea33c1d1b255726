"""Majority votes over candidate answers, their counts, and accuracy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import with_group_place


def tally(candidates: DataFrame, problem: str, answer: str, order: Sequence[str]) -> DataFrame:
    """Votes and first place per problem and answer: ``vote_count`` and ``first_seen``.

    Unreadable answers (null) are tallied as well, so every problem stays.
    Answers are below 1000, so after the map-side step even a problem with
    most of the rows is at most a thousand rows per task. All order columns
    but the last are grouped on first to keep the aggregates primitive.
    """
    *outer, last = order
    counts = candidates.groupBy(problem, answer, *outer).agg(
        F.count(F.lit(1)).alias("vote_count"), F.min(last).alias("first_seen")
    )
    if not outer:
        return counts
    return counts.groupBy(problem, answer).agg(
        F.sum("vote_count").alias("vote_count"),
        F.min(F.struct(*outer, F.col("first_seen").alias(last))).alias("first_seen"),
    )


def vote_from_tally(counts: DataFrame, problem: str, answer: str, target: str = "answer") -> DataFrame:
    """Most frequent answer per problem, the first seen among equals, else 0."""
    rank = F.struct((-F.col("vote_count")).alias("vote_count"), F.col("first_seen"))
    best = F.min_by(F.col(answer), F.when(F.col(answer).isNotNull(), rank))
    return counts.groupBy(problem).agg(F.coalesce(best, F.lit(0)).alias(target))


def majority_vote(
    candidates: DataFrame,
    problem: str,
    answer: str,
    order: Sequence[str],
    problems: DataFrame | None = None,
    target: str = "answer",
) -> DataFrame:
    """One row per problem. ``problems`` adds those without any candidate."""
    votes = vote_from_tally(tally(candidates, problem, answer, order), problem, answer, target)
    if problems is None:
        return votes
    joined = problems.select(problem).join(votes, problem, "left")
    return joined.select(problem, F.coalesce(target, F.lit(0)).alias(target))


def candidate_counts(candidates: DataFrame, problem: str, answer: str) -> DataFrame:
    """Candidates per problem before and after the numeric filter."""
    return candidates.groupBy(problem).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count(answer).alias("n_filtered")
    )


def candidate_list(candidates: DataFrame, problem: str, order: Sequence[str]) -> DataFrame:
    """The candidates of each problem as a numbered list, one row per entry.

    Rows instead of one array per problem, so a list of any length fits.
    """
    return with_group_place(candidates, [problem], order, "place")


def accuracy(
    truth: DataFrame, predictions: DataFrame, on: Sequence[str], expected: str, predicted: str
) -> DataFrame:
    """Share of predictions equal to the truth over the rows both sides have."""
    joined = truth.join(predictions, list(on), "inner")
    correct = (F.col(expected).cast("int") == F.col(predicted).cast("int")).cast("int")
    return joined.agg(F.count(F.lit(1)).alias("n_problems"), F.avg(correct).alias("accuracy"))
