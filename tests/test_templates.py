import pytest

from tallyloom.functions import templates as T
from tests.conftest import column

SYSTEM, USER, REPLY = ("system", "S"), ("user", "A"), ("assistant", "B")
EMPTY_SYSTEM = "<|im_start|>system\n<|im_end|>\n"


def render(spark, turns, template, task):
    rows = spark.createDataFrame([(turns,)], f"messages {T.MESSAGES_TYPE}")
    return column(rows.select(T.chat_text("messages", template, task).alias("t")), "t")[0]


@pytest.mark.parametrize(
    "turns, template, task, expected",
    [
        ([USER, REPLY], T.PROBLEM_SOLUTION, "sft", "### Problem: A\n### Solution: B\n"),
        ([SYSTEM, USER], T.PROBLEM_SOLUTION, "generation", "### Problem: A\n### Solution: "),
        ([USER, REPLY], T.PROBLEM_SOLUTION, "generation", "### Problem: A\n### Solution: B\n"),
        ([("tool", "x"), USER], T.PROBLEM_SOLUTION, "sft", "### Problem: A\n"),
        ([USER], T.CHATML, "sft", EMPTY_SYSTEM + "<|im_start|>user\nA<|im_end|>\n"),
        (
            [USER],
            T.CHATML,
            "generation",
            EMPTY_SYSTEM + "<|im_start|>user\nA<|im_end|>\n<|im_start|>assistant\n",
        ),
        ([SYSTEM], T.CHATML, "sft", "<|im_start|>system\nS<|im_end|>\n"),
        ([], T.CHATML, "sft", EMPTY_SYSTEM),
        ([], T.PROBLEM_SOLUTION, "generation", ""),
        ([("user", None)], T.PROBLEM_SOLUTION, "sft", "### Problem: \n"),
    ],
)
def test_chat_text(spark, turns, template, task, expected):
    assert render(spark, turns, template, task) == expected


def test_other_tasks_are_refused():
    with pytest.raises(ValueError, match="no task"):
        T.chat_text("messages", T.CHATML, "rank")


def test_template_precedence():
    assert T.choose_template(T.PROBLEM_SOLUTION, T.CHATML) is T.PROBLEM_SOLUTION
    assert T.choose_template(None, T.PROBLEM_SOLUTION) is T.PROBLEM_SOLUTION
    assert T.choose_template() is T.CHATML


def test_prompt_and_calibration_text(spark):
    rows = spark.createDataFrame([("P", [USER, REPLY]), ("Q", [USER])], f"problem string, messages {T.MESSAGES_TYPE}")
    shown = rows.select(
        T.prompt_text("problem").alias("p"),
        T.prompt_text("problem", prompt="<{}|{}|{{x}}|{0}>").alias("f"),
        T.prompt_text("problem", T.CHATML).alias("m"),
        T.calibration_text("problem", "messages").alias("c"),
    ).collect()
    assert shown[0].p == "### Problem: P\n### Solution: "
    assert shown[0].f == "### Problem: <P|{}|{x}|P>\n### Solution: "
    assert shown[0].m == "<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\n"
    assert shown[0].c == "### Problem: P\n### Solution: B\n"
    assert shown[1].c == "### Problem: Q\n### Solution: \n"
