"""Rejection filtering of candidate solutions against reference answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import boxed_answer, number_value, numeric_answer, with_clean_answer
from ..functions.blocks import mentions_box
from ..functions.columns import as_column
from ..operators.lookup import lookup
from ..session import settle, spread
from .tracing import BATCH_SIZE, BatchFunction, batched


def numeric_problems(problems: DataFrame, answer: str, integer_only: bool = False) -> DataFrame:
    """Problems whose answer is a number, or a whole number."""
    kept = numeric_answer(answer).isNotNull()
    if integer_only:
        value = number_value(answer)
        kept = kept & (value == F.rint(value))
    return problems.filter(kept)


def with_final_answer(df: DataFrame, text: Column | str, target: str) -> DataFrame:
    """Clean answer of a solution: what its last box holds, or all of the text."""
    text = as_column(text)
    return with_clean_answer(df, F.when(mentions_box(text), boxed_answer(text)).otherwise(text), target)


def expected_answers(references: DataFrame, problem: str, reference: str) -> DataFrame:
    """Problem and clean reference answer, one row per problem."""
    return with_final_answer(references, reference, "expected").select(problem, "expected")


def _matches(df: DataFrame, solution: str) -> DataFrame:
    answered = with_final_answer(df, solution, "final_answer")
    return answered.filter(F.col("final_answer") == F.col("expected")).drop("expected")


def matching_solutions(
    candidates: DataFrame, references: DataFrame, problem: str, solution: str, order: str, reference: str
) -> DataFrame:
    """Candidates whose final answer equals the reference answer of their problem.

    ``references`` holds one row per problem. A problem with most of the
    candidates is salted by ``order`` if the references cannot be broadcast.
    """
    known = expected_answers(references, problem, reference)
    return _matches(lookup(candidates, known, [problem], [order]), solution)


def rejection_rounds(
    candidates: DataFrame,
    references: DataFrame,
    problem: str,
    solution: str,
    order: str,
    reference: str,
    attempt: str = "round",
) -> DataFrame:
    """Accepted solutions when only unsolved problems go to the next round.

    A problem is closed by its first round with a match, so the rounds need no
    loop: find that round per problem, then keep its matches. All matches are
    stored once, so every solution is cleaned once.
    """
    matched = settle(matching_solutions(candidates, references, problem, solution, order, reference))
    closed = matched.groupBy(problem).agg(F.min(attempt).alias("__closed"))
    found = lookup(matched, closed, [problem], [order]).filter(F.col(attempt) == F.col("__closed"))
    return found.drop("__closed")


def generate_rounds(
    problems: DataFrame,
    references: DataFrame,
    problem: str,
    prompt: str,
    reference: str,
    make_generate: Callable[[], BatchFunction],
    rounds: int,
    samples: int = 1,
    batch_size: int = BATCH_SIZE,
    ask: Callable[[Column, int, Column], Column] | None = None,
) -> DataFrame:
    """Accepted solutions of rounds in which a model is asked for open problems only.

    Every round asks ``samples`` times for each problem without an accepted
    solution, keeps the answers that match its reference, and leaves the others
    to the next round. It ends after ``rounds`` rounds, or as soon as no problem is open.
    What a model says cannot be asked for again, so every round is stored.
    ``ask`` may word the prompt anew from the prompt, the round and the sample.

    ``problems`` holds one row per problem with its prompt, ``references`` one
    with its reference answer; problems without one are never asked. Columns:
    the problem, ``round`` and ``sample_id`` from 0, ``solution``, ``final_answer``.
    """
    if rounds < 1 or samples < 1:
        raise ValueError("there has to be a round and a sample")
    known = expected_answers(references, problem, reference).filter("expected is not null")
    waiting = settle(lookup(problems.select(problem, F.col(prompt).alias("__prompt")), known, [problem], [problem]))
    accepted = []
    for number in range(rounds):
        asked = waiting.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        if ask is not None:
            asked = asked.withColumn("__prompt", ask(F.col("__prompt"), number, F.col("sample_id")))
        said = settle(spread(asked).withColumn("solution", batched("__prompt", make_generate, batch_size)))
        matched = _matches(said.drop("__prompt").withColumn("round", F.lit(number)), "solution")
        accepted.append(settle(matched.select(problem, "round", "sample_id", "solution", "final_answer")))
        if number + 1 < rounds:
            solved = accepted[-1].select(problem).distinct()
            waiting = settle(waiting.join(solved, problem, "left_anti"))
            if waiting.isEmpty():
                break
    return reduce(DataFrame.unionByName, accepted)


def unsolved(problems: DataFrame, accepted: DataFrame, problem: str) -> DataFrame:
    """Problems without an accepted solution: the input of the next round."""
    return problems.join(accepted.select(problem).distinct(), problem, "left_anti")
