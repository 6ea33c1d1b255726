import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lookup as lookup_module
from tallyloom.plans import rejection


def test_numeric_problems(spark):
    rows = spark.createDataFrame([("1",), ("2.5",), ("x",), ("-4",), ("3.0",), ("١٢",)], "a string")
    assert sorted(r.a for r in rejection.numeric_problems(rows, "a").collect()) == ["1", "2.5", "3.0", "١٢"]
    assert sorted(r.a for r in rejection.numeric_problems(rows, "a", True).collect()) == ["1", "3.0", "١٢"]


@pytest.mark.parametrize("small", [True, False])
def test_rounds_against_a_loop_with_one_hot_problem(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lookup_module.lookup, "__defaults__", ("inner", 2, 50))
    dice = random.Random(2)
    answers = {p: dice.randrange(4) for p in range(30)}
    tries = [(dice.choice([0, 0, dice.randrange(31)]), i, dice.randrange(3), dice.randrange(40)) for i in range(900)]
    references = spark.createDataFrame([(p, f"${a}$") for p, a in answers.items()], "p int, known string")
    candidates = spark.createDataFrame(
        [(p, i, r, f"so \\boxed{{{a}}} units") for p, i, r, a in tries], "p int, i int, round int, s string"
    )
    accepted, solved = set(), set()
    for round_ in range(3):
        hits = {(p, i) for p, i, r, a in tries if r == round_ and p not in solved and answers.get(p) == a}
        accepted |= hits
        solved |= {p for p, _ in hits}
    found = rejection.rejection_rounds(candidates, references, "p", "s", "i", "known")
    assert {(r.p, r.i) for r in found.collect()} == accepted
    assert set(found.columns) == {"p", "i", "round", "s", "final_answer"}
    left = rejection.unsolved(references, found, "p")
    assert {r.p for r in left.collect()} == set(answers) - solved
    kept = rejection.matching_solutions(candidates, references, "p", "s", "i", "known")
    assert {(r.p, r.i) for r in kept.collect()} == {(p, i) for p, i, _, a in tries if answers.get(p) == a}


@pytest.mark.parametrize("samples", [1, 3])
def test_solved_problems_are_not_asked_again(spark, tmp_path, samples):
    log = str(tmp_path / "asked")

    def make():
        def reply(texts):
            with open(log, "a") as out:
                out.writelines(f"{text}\n" for text in texts)
            # Problem n is solved in round n; number 9 never.
            return [f"\\boxed{{{7 if int(text.split()[1]) == int(text.split()[0]) else 0}}}" for text in texts]

        return reply

    problems = spark.createDataFrame([(n, str(n)) for n in (0, 0 + 1, 2, 9, 11)], "p int, t string")
    references = spark.createDataFrame([(n, "7") for n in (0, 1, 2, 9)] + [(11, None)], "p int, known string")

    def ask(prompt, number, sample):
        return F.concat_ws(" ", prompt, F.lit(str(number)))

    found = rejection.generate_rounds(problems, references, "p", "t", "known", make, 4, samples, ask=ask)
    assert sorted((r.p, r.round, r.sample_id) for r in found.collect()) == [(n, n, s) for n in (0, 1, 2) for s in range(samples)]
    asked = [tuple(map(int, line.split())) for line in open(log)]
    expected = [(n, r) for r in range(4) for n in (0, 1, 2, 9) if n >= r]
    assert sorted(asked) == sorted(expected * samples)


def test_rounds_end_when_no_problem_is_open(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def reply(texts):
            open(log, "a").write("x" * len(texts))
            return ["\\boxed{1}"] * len(texts)

        return reply

    problems = spark.createDataFrame([(1, "a"), (2, "b")], "p int, t string")
    references = spark.createDataFrame([(1, "1"), (2, "1")], "p int, known string")
    found = rejection.generate_rounds(problems, references, "p", "t", "known", make, 5)
    assert found.count() == 2 and open(log).read() == "xx"
    none = rejection.generate_rounds(problems.filter("false"), references, "p", "t", "known", make, 5)
    assert none.collect() == []
    with pytest.raises(ValueError, match="has to be"):
        rejection.generate_rounds(problems, references, "p", "t", "known", make, 0)
