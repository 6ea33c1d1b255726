from pyspark.sql import functions as F

from tallyloom.functions import blocks
from tests.conftest import column, values

CODE = "```python\nprint(1)\n```\n"
OUTPUT = "```output\n1\n```\n"


def test_block_counts(spark):
    texts = ["", CODE, CODE + OUTPUT + CODE, "```python\nopen", OUTPUT + "```output"]
    assert values(spark, blocks.code_block_count, texts) == [0, 1, 2, 0, 0]
    assert values(spark, blocks.output_block_count, texts) == [0, 0, 1, 0, 1]
    assert values(spark, blocks.has_code_block, texts) == [False, True, True, False, False]
    assert values(spark, blocks.has_output_block, texts) == [False, False, True, False, True]


def test_last_code_block_and_blocked_libraries(spark):
    texts = [CODE + "```python\nimport subprocess\n```", CODE, "none", "```python x```"]
    assert values(spark, blocks.last_code_block, texts) == ["\nimport subprocess\n", "\nprint(1)\n", None, " x"]
    assert values(spark, blocks.uses_blocked_library, ["a venv b", "subprocess", "os"]) == [True, True, False]


def test_region_and_markers(spark):
    assert values(spark, blocks.answer_region, ["é" * 150, "short"]) == ["é" * 100, "short"]
    assert values(spark, blocks.asks_for_output, ["x```output\n", "x```output", ""]) == [True, False, False]
    assert values(spark, blocks.states_answer, ["answer is 3", r"\boxed", "boxed", ""]) == [True, True, False, False]


def test_output_is_shortened_and_appended(spark):
    texts = ["a" * 200, "b" * 201]
    assert values(spark, blocks.shorten_output, texts) == ["a" * 200, "b" * 200 + " ... (output truncated)"]
    assert values(spark, lambda x: blocks.append_output(F.lit("t\n"), x), ["7"]) == ["t\n7\n```"]


SCRIPT = "/tmp/d/tmp.py"
REPORTS = [
    # The line after a script line is kept, a library line and its detail are not.
    (
        f'Traceback (most recent call last):\n  File "{SCRIPT}", line 2, in <module>\n    f()\n'
        '  File "/lib/x.py", line 3, in g\n    raise\nValueError: no\n',
        'Traceback (most recent call last):\n  File "\n    f()\nValueError: no',
    ),
    # Two script lines in a row raise the flag once; one detail line lowers it.
    (f'  File "{SCRIPT}", 1\n  File "{SCRIPT}", 2\n  a\n  b\nE', 'File "\n  File "\n  a\nE'),
    # Traceback lines and lines equal to the last one do not lower the flag.
    (f'  File "{SCRIPT}", 1\nE\nTraceback\n  a\n  b\nE', 'File "\nE\nTraceback\n  a\nE'),
    # Without a quoted path nothing of the line stays.
    (f"run {SCRIPT} broke\nnext\nskipped\nE", "next\nE"),
    ("  only line  ", "only line"),
    ("", ""),
]


def test_compact_traceback(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(REPORTS)], "i int, e string")
    shown = blocks.with_compact_traceback(rows, "e", F.lit(SCRIPT), "r").orderBy("i")
    assert column(shown, "r") == [out for _, out in REPORTS]


def test_execution_text(spark):
    rows = spark.createDataFrame(
        [(0, " 5\n", True, ""), (1, "", False, "Traceback\nx\nE\n")], "i int, out string, ok boolean, err string"
    )
    shown = blocks.with_execution_text(rows, "out", "ok", "err", F.lit(SCRIPT), "t").orderBy("i")
    assert column(shown, "t") == ["5", "Traceback\nE"]
