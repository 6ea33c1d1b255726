import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import votes


def vote(spark, answers, **kw):
    rows = [(1, i, a) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "p int, i int, a int")
    return [row.answer for row in votes.majority_vote(df, "p", "a", ["i"], **kw).collect()]


@pytest.mark.parametrize(
    "answers, expected", [([5, 7, 7, 5], 5), ([7, 5, 5], 5), ([None, 3], 3), ([None, None], 0), ([0, 1, 1, 0], 0)]
)
def test_majority_and_ties(spark, answers, expected):
    assert vote(spark, answers) == [expected]


def test_problems_without_candidates_get_zero(spark):
    df = spark.createDataFrame([(1, 0, 9)], "p int, i int, a int")
    problems = spark.createDataFrame([(1,), (2,)], "p int")
    found = votes.majority_vote(df, "p", "a", ["i"], problems)
    assert {row.p: row.answer for row in found.collect()} == {1: 9, 2: 0}


def test_leading_order_column_decides_ties_first(spark):
    rows = [(1, 4, 0, 5), (1, 0, 9, 6), (1, 4, 1, 6), (1, 0, 10, 5)]
    df = spark.createDataFrame(rows, "p int, stop int, i int, a int")
    assert votes.majority_vote(df, "p", "a", ["stop", "i"]).first().answer == 6


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_vote_does_not_depend_on_partitions(spark, partitions):
    dice = random.Random(0)
    # Problem 0 holds more than a third of all rows.
    rows = [(dice.choice([0, 0, dice.randrange(50)]), i, dice.choice([None, *range(6)])) for i in range(4000)]
    expected = {}
    for p in {row[0] for row in rows}:
        seen = [a for q, _, a in rows if q == p and a is not None]
        expected[p] = max(seen, key=lambda a: (seen.count(a), -seen.index(a)))
    df = spark.createDataFrame(rows, "p int, i int, a int").repartition(partitions)
    found = votes.majority_vote(df, "p", "a", ["i"])
    assert {row.p: row.answer for row in found.collect()} == expected


def test_counts_list_and_accuracy(spark):
    df = spark.createDataFrame([(1, 3, "x", 1), (1, 2, "y", None), (2, 1, "z", 4)], "p int, i int, t string, a int")
    counts = {row.p: (row.n_candidates, row.n_filtered) for row in votes.candidate_counts(df, "p", "a").collect()}
    assert counts == {1: (2, 1), 2: (1, 1)}
    places = {row.t: row.place for row in votes.candidate_list(df, "p", ["i"]).collect()}
    assert places == {"y": 0, "x": 1, "z": 0}
    truth = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, problem string, t int")
    guess = spark.createDataFrame([(1, "a", 5), (2, "b", 0), (9, "c", 7)], "id int, problem string, m int")
    result = votes.accuracy(truth, guess, ["id", "problem"], "t", "m").first()
    assert (result.n_problems, result.accuracy) == (2, 0.5)
    assert votes.accuracy(truth, guess.filter(F.lit(False)), ["id", "problem"], "t", "m").first().accuracy is None
