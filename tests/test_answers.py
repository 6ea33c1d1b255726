import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import oracle_queries
from tallyloom.functions.answers import answer_class, boxed_answer, numeric_answer, with_clean_answer
from tests.conftest import column, values

BOXES = [
    (r"\boxed{42}", "42"),
    (r"\boxed{1} then \boxed{2}", "2"),
    (r"\boxed{\frac{1}{2}} end", r"\frac{1}{2}"),
    (r"\boxed{3", None),
    (r"\boxed{1} or \boxed{3", None),
    (r"\boxed 5", None),
    (r"\boxed 5 {6}", None),
    (r"\fbox{9}", None),
    ("no box", None),
    (r"\boxed{}", ""),
    (r"\boxed{a{b}c{d}}} {e}", "a{b}c{d}"),
    (None, None),
]

CLEAN = [
    ("42", "42"),
    ("$1,234$", "1234"),
    (r"\frac12", r"\frac{1}{2}"),
    ("frac12", r"f\frac{1}{2}"),
    (r"\sqrt2", r"\sqrt{2}"),
    ("The answer is $7$.", "7"),
    ("answer is 11", "11"),
    ("The final answer is: 12 units", ":12"),
    (r"\text{12}", "12"),
    (r"12^\circ", "12"),
    (r"\left(3,4\right)", r"<(3,4\right)"),
    (r"\boxed{9}", "9"),
    ("$x$ then $8$", "8"),
    (r"\$30", "30"),
    (r"3\text{ cm}", "3"),
    (r"\mbox{6}", "6"),
    ("a bn 4", "bn4"),
    ("1{,}500", "1500"),
    (r"50\%", "50"),
    ("50%", "50%"),
    ("5 Problem: next", "5"),
    ("5\x85 ", "5"),
    ("\u0661,\u0662", "\u0661\u0662"),
    ("1,\u00b2", "1\u00b2"),
    ("1,2\u2028$", "1,2\u2028"),
    ("", ""),
    (None, None),
]

NUMBERS = [
    ("2.5", 2), ("3.5", 4), ("-0.5", 0), ("-3", None), ("1234", 234), ("1e3", 0), ("1_000", 0),
    (" 12 ", 12), (" 7\n", 7), ("1e300", 160), ("nan", None), ("inf", None), ("1e400", None), ("", None),
    ("1,000", None), ("1d", None), ("5f", None), ("0x1p3", None), (r"\frac{1}{2}", None), ("5.", 5),
    (".5", 0), ("1.5", 2), ("+7", 7), ("1e1_0", 0), ("_1", None), ("1__0", None), ("1_", None),
    ("\u0661\u0662", 12), ("\U0001d7d7.\u0665", 10), ("\u00b2", None), ("12\u2028", 12), (None, None),
]


def test_boxed_answer(spark):
    assert values(spark, boxed_answer, [text for text, _ in BOXES]) == [out for _, out in BOXES]


def test_boxed_answer_in_a_long_text(spark):
    long = "x" * 50_000 + r"\boxed{" + "{a}" * 2_000 + "}" + "y}" * 5_000
    assert values(spark, boxed_answer, [long]) == ["{a}" * 2_000]


def test_clean_answer(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CLEAN)], "i int, t string")
    assert column(with_clean_answer(rows, "t", "c").orderBy("i"), "c") == [out for _, out in CLEAN]


def test_numeric_answer(spark):
    assert values(spark, numeric_answer, [text for text, _ in NUMBERS]) == [out for _, out in NUMBERS]


def test_answer_class(spark):
    assert values(spark, answer_class, [5, 1005, -1, 0], "bigint") == [5, 5, 999, 0]
    assert values(spark, answer_class, [12.9, 1999.99], "double") == [12, 999]


def test_filter_on_a_clean_answer_does_not_repeat_the_work(spark):
    rows = spark.createDataFrame([("7",)], "t string")
    kept = with_clean_answer(rows, "t", "c").filter("c is not null").filter(numeric_answer("c").isNotNull())
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("childrentickets") == 1


FRAGMENTS = st.sampled_from(
    ["an ", "a ", ".$", "$", "\\", " ", "mbox", ",\\text{and}", "\\text{", "\\textbf{", "\\overline{", "}", "{",
     "\\boxed{", "\\le", "units", "ft", "\\ldots", "\\text{}^2", "^\\circ", "{,}", '"', "\n", "\r", "\f", "\\%",
     "answer is", "The final answer is", "oxed{", "rac", "\\frac", "frac", "sqrt", "1", "23", ",", "x", "é",
     "Problem:", ":", " ", "-1", ".5", "'"]
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.lists(st.lists(FRAGMENTS, max_size=9).map("".join), min_size=400, max_size=400, unique=True))
def test_both_engines_agree_on_random_answers(spark, texts):
    con = duckdb.connect()
    con.execute("create table src (i int, t varchar)")
    con.executemany("insert into src values (?, ?)", list(enumerate(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ours = with_clean_answer(rows, "t", "c").select("i", "t", boxed_answer("t").alias("b"), "c")
    ours = ours.withColumn("n", numeric_answer("c")).orderBy("i").collect()
    boxed = con.execute(
        f"select i, b from ({oracle_queries.boxed('select * from src', 'i', 't', 'b')}) order by i"
    ).fetchall()
    clean = con.execute(
        f"select i, c, {oracle_queries.numeric('c')} as n "
        f"from ({oracle_queries.clean('select * from src', 'i', 't', 'c')}) order by i"
    ).fetchall()
    for row, (_, b), (_, c, n) in zip(ours, boxed, clean, strict=True):
        assert (row.t, row.b, row.c, row.n) == (row.t, b, c, n)


if __name__ == "__main__":
    pytest.main([__file__])
