import pytest

from tallyloom.functions import templates as T
from tallyloom.functions.template_text import compile_template
from tests.conftest import column

SYSTEM, USER, REPLY = ("system", "S"), ("user", "A"), ("assistant", "B")
TALKS = [[USER, REPLY], [SYSTEM, USER], [USER], [SYSTEM], [], [("tool", "x"), USER], [("user", None)], [(None, "y"), REPLY, USER, REPLY]]


def shown(spark, source, turns, generation=False):
    rows = spark.createDataFrame([(t,) for t in turns], f"messages {T.MESSAGES_TYPE}").coalesce(1)
    return column(rows.select(compile_template(source).text("messages", generation).alias("t")), "t")


@pytest.mark.parametrize("task", T.TASKS)
@pytest.mark.parametrize("source, template", [(T.PROBLEM_SOLUTION_TEXT, T.PROBLEM_SOLUTION), (T.CHATML_TEXT, T.CHATML)])
def test_texts_of_configurations_equal_the_built_in_templates(spark, source, template, task):
    rows = spark.createDataFrame([(t,) for t in TALKS], f"messages {T.MESSAGES_TYPE}").coalesce(1)
    both = rows.select(
        T.chat_text("messages", T.choose_template(source), task).alias("a"), T.chat_text("messages", template, task).alias("b")
    ).collect()
    assert [row.a for row in both] == [row.b for row in both]


@pytest.mark.parametrize(
    "source, turns, expected",
    [
        ("plain", [USER], "plain"),
        ("", [USER], ""),
        ("{% for m in messages %}{{ m.role }}={{ m['content'] }};{% endfor %}", [USER, REPLY], "user=A;assistant=B;"),
        ("{% for m in messages %}{% if loop.first %}<{% endif %}{{ m.content }}{% if not loop.last %}, {% else %}>{% endif %}{% endfor %}", [USER, REPLY], "<A, B>"),
        ("{% for m in messages %}{% if loop.index == 2 %}{{ m.role }}{% elif loop.index0 != 0 %}-{% endif %}{% endfor %}", [USER, REPLY, USER], "assistant-"),
        ("{% for m in messages %}{{ m.content | trim ~ '|' }}{% endfor %}", [("user", " \n x ")], "x|"),
        ('{% for m in messages %}{{ "a\'b\\t" + m.role }}{% endfor %}', [USER], "a'b\tuser"),
        ("{# note #}{% set bos = '<s>' %}{{ bos }}{% if nothing is defined %}no{% endif %}{{ nothing }}", [USER], "<s>"),
        ("{% for m in messages %}{% if m.role == 'user' or m.role == 'tool' and not m.content %}1{% else %}0{% endif %}{% endfor %}", [USER, ("tool", ""), ("tool", "x")], "110"),
        ("{% for m in messages %}\n  {% if true %}\n{{ m.content }}\n  {% endif %}\n{% endfor %}\n", [USER, REPLY], "A\nB\n"),
        ("{% for m in messages -%}  x  {%- endfor %} y", [USER], "x y"),
        ("{% if add_generation_prompt %}yes{% else %}no{% endif %}", [USER], "no"),
        ("{% for m in messages %}{% if m.content %}{{ m.content }}{% else %}empty{% endif %}{% endfor %}", [USER, ("user", None)], "Aempty"),
    ],
)
def test_constructs(spark, source, turns, expected):
    assert shown(spark, source, [turns]) == [expected]


@pytest.mark.parametrize(
    "source",
    [
        "{% macro f() %}{% endmacro %}",
        "{% for m in messages[1:] %}{% endfor %}",
        "{% for m in messages %}{% for x in messages %}{% endfor %}{% endfor %}",
        "{% for m in messages %}{% set a = m.role %}{% endfor %}",
        "{% for m in messages %}{{ m.name }}{% endfor %}",
        "{% for m in messages %}",
        "{% if true %}x",
        "{{ messages[0]['role'] }}",
        "{{ 1 + 'a' }}",
        "{{ 'a' | upper }}",
        "{{ raise_exception('no') }}",
        "{{ 'a' if true else 'b' }}",
        "{{ 'a' 'b' }}",
        "{{ a < b }}",
        "{{ 'open }}",
        "{{ x",
        "{% if loop.last %}{% endif %}",
    ],
)
def test_unsupported_constructs_raise_when_compiled(spark, source):
    with pytest.raises(ValueError, match="template cannot hold"):
        compile_template(source)


def test_turns_as_rows_equal_turns_in_arrays(spark):
    from tallyloom.operators.conversations import render_turns

    rows = [(c, t, role, text) for c, talk in enumerate(TALKS) for t, (role, text) in enumerate(talk)]
    table = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(3)
    source = "{{ '^' }}{% for m in messages %}{% if loop.first %}1{% endif %}{{ m.role + ':' + m.content }}{% if loop.last %}!{% endif %}{% endfor %}{% if add_generation_prompt %}>{% endif %}"
    for text in (source, T.PROBLEM_SOLUTION_TEXT, T.CHATML_TEXT):
        for task in T.TASKS:
            template = compile_template(text)
            parts = {}
            for row in render_turns(table, "conv", "turn", "role", "text", template, task).orderBy("conv", "turn").collect():
                parts[row.conv] = parts.get(row.conv, "") + row.text
            arrays = spark.createDataFrame([(c, t) for c, t in enumerate(TALKS) if t], f"conv long, messages {T.MESSAGES_TYPE}")
            assert parts == dict(map(tuple, arrays.select("conv", T.chat_text("messages", template, task)).collect()))
    with pytest.raises(ValueError, match="loop.index"):
        render_turns(table, "conv", "turn", "role", "text", compile_template("{% for m in messages %}{{ loop.index }}{% endfor %}"), "sft")


def test_prompt_leaves_no_trace_in_training_text(spark):
    rows = spark.createDataFrame([([USER],)], f"messages {T.MESSAGES_TYPE}")
    template = T.choose_template(T.CHATML_TEXT)
    plan = rows.select(T.chat_text("messages", template, "sft"))._jdf.queryExecution().optimizedPlan().toString()
    assert "<|im_start|>assistant" not in plan
