"""Chat rendering: an array of {role, content} turns to one text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column
from .template_text import TextTemplate, compile_template

TASKS = ("sft", "generation")
MESSAGES_TYPE = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Template:
    """How one turn looks, and what asks the model to go on.

    ``turn`` renders role and content; ``opener`` gets the role of the last
    turn (null without turns) and returns the text that opens the reply.
    """

    name: str
    turn: Callable[[Column, Column], Column]
    opener: Callable[[Column], Column]


# Markers of the two templates.
def _chatml_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def _problem_turn(role: Column, content: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("### Problem: "), content, F.lit("\n")))
        .when(role == "assistant", F.concat(F.lit("### Solution: "), content, F.lit("\n")))
        .otherwise(F.lit(""))
    )


CHATML = Template("chatml", _chatml_turn, lambda last: F.lit("<|im_start|>assistant\n"))
PROBLEM_SOLUTION = Template(
    "problem_solution",
    _problem_turn,
    lambda last: F.when(last == "user", F.lit("### Solution: ")).otherwise(F.lit("")),
)


# Template texts as the training configurations and the default hold them.
PROBLEM_SOLUTION_TEXT = (
    "{% for message in messages %}{% if (message['role'] == 'system')%}{{ '' }}"
    "{% elif (message['role'] == 'user')%}{{ '### Problem: ' + message['content'] + '\n' }}"
    "{% elif (message['role'] == 'assistant')%}{{ '### Solution: ' + message['content'] + '\n' }}{% endif %}"
    "{% if loop.last and message['role'] == 'user' and add_generation_prompt %}{{ '### Solution: ' }}{% endif %}{% endfor %}"
)
CHATML_TEXT = (
    "{% if not add_generation_prompt is defined %}{% set add_generation_prompt = false %}{% endif %}"
    "{% for message in messages %}"
    "{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}"
    "{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
)

AnyTemplate = Template | TextTemplate


def choose_template(configured: AnyTemplate | str | None = None, tokenizer: AnyTemplate | str | None = None) -> AnyTemplate:
    """The configured template, else the tokenizer's own, else ChatML; a text is compiled."""
    chosen = configured or tokenizer or CHATML
    return compile_template(chosen) if isinstance(chosen, str) else chosen


def turn(role: Column | str, content: Column | str) -> Column:
    return F.struct(as_column(role).alias("role"), as_column(content).alias("content"))


def with_system_turn(messages: Column | str) -> Column:
    """Put an empty system turn first unless the first turn is a system turn."""
    messages = as_column(messages)
    first = F.get(messages, F.lit(0))["role"]
    empty = F.array(turn(F.lit("system"), F.lit(""))).cast(MESSAGES_TYPE)
    return F.when(first == "system", messages).otherwise(F.concat(empty, messages.cast(MESSAGES_TYPE)))


def _text(messages: Column, template: Template) -> Column:
    turns = F.transform(
        messages, lambda m: template.turn(F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")))
    )
    return F.array_join(turns, "")


def render(
    messages: Column | str,
    template: AnyTemplate,
    generation: bool = False,
) -> Column:
    """Render turns as they are."""
    messages = as_column(messages)
    if isinstance(template, TextTemplate):
        return template.text(messages, generation)
    text = _text(messages, template)
    if not generation:
        return text
    return F.concat(text, template.opener(F.get(messages, F.size(messages) - 1)["role"]))


def chat_text(
    messages: Column | str,
    template: AnyTemplate,
    task: str,
) -> Column:
    """Text of a conversation for training (``sft``) or prompting (``generation``): one row in, one out."""
    if task not in TASKS:
        raise ValueError(f"{task!r} is no task to render for; there are {', '.join(TASKS)}")
    return render(with_system_turn(messages), template, task == "generation")


def fill_prompt(prompt: str, problem: Column | str) -> Column:
    """Python format string with the problem as value 0 and ``{}`` as value 1."""
    values = [as_column(problem), F.lit("{}")]
    parts, unnamed = [], 0
    for literal, field, _, _ in Formatter().parse(prompt):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[int(field) if field else unnamed])
            unnamed += not field
    return F.concat(F.lit(""), *parts)


def prompt_text(problem: Column | str, template: Template = PROBLEM_SOLUTION, prompt: str = "{}") -> Column:
    """The text that asks for a solution of one problem: a user turn and the opener."""
    user = F.lit("user")
    asked = template.turn(user, F.coalesce(fill_prompt(prompt, problem), F.lit("")))
    return F.concat(asked, template.opener(user))


def calibration_text(
    problem: Column | str, messages: Column | str, template: Template = PROBLEM_SOLUTION, prompt: str = "{}"
) -> Column:
    """Problem plus the second turn of its conversation, taken by position."""
    reply = F.get(as_column(messages), F.lit(1))["content"]
    return F.concat(
        template.turn(F.lit("user"), F.coalesce(fill_prompt(prompt, problem), F.lit(""))),
        template.turn(F.lit("assistant"), F.coalesce(reply, F.lit(""))),
    )
