import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import blocks
from tallyloom.plans import tracing

PROMPT = "### Problem: p\n### Solution: "
CODE = "```python\nprint(1)\n```\n"
ASK = "```output\n"
BOX = "So \\boxed{12}"


def run(spark, completions, restart, outputs=(), num_steps=None, **options):
    """Final state of one trace with the given completions and outputs per step."""
    steps = num_steps or len(completions)
    traces = spark.createDataFrame([(1, 1, PROMPT)], "problem_id long, sample_id long, text string")
    keys = "problem_id long, sample_id long, step int"
    made = spark.createDataFrame([(1, 1, i, c) for i, c in enumerate(completions)], f"{keys}, completion string")
    ran = spark.createDataFrame([(1, 1, i, o) for i, o in enumerate(outputs)], f"{keys}, output string")
    return tracing.score_traces(traces, made, ran, steps, restart, **options).first()


def test_without_code(spark):
    again = run(spark, ["text", CODE + "x"], True)
    assert again.gen_texts == PROMPT + CODE + "x" and again.pruned_step is None and again.has_code
    stopped = run(spark, ["text", CODE + "x"], False)
    assert (stopped.pruned_step, stopped.should_prune, stopped.has_code) == (0, True, False)
    assert stopped.gen_texts == PROMPT + "text"


def test_answer_without_output_block_is_pruned_in_both_modes(spark):
    for restart in (True, False):
        row = run(spark, [CODE + BOX, ""], restart)
        assert (row.pruned_step, row.model_answers, row.has_code) == (0, "-1", True)


@pytest.mark.parametrize("stated, answer", [(BOX, "12"), ("The answer is $7$.", "7"), ("answer is \\boxed{3", "-1")])
def test_answer_after_an_output_block_keeps_the_trace_alive(spark, stated, answer):
    output = "1" * 60
    row = run(spark, [CODE + ASK, "\n" + stated], False, [output])
    assert (row.model_answers, row.should_prune) == (answer, False)
    assert row.gen_texts == PROMPT + CODE + ASK + output + "\n```\n" + stated


def test_a_region_that_reaches_into_the_prompt_ends_at_its_problem(spark):
    row = run(spark, [CODE + ASK, "\nThe answer is $7$."], True, ["1"])
    assert len(row.gen_texts) < 100 and row.model_answers == "###"


def test_a_later_answer_wins_and_a_restart_keeps_it(spark):
    row = run(spark, [CODE + ASK, BOX, " no, \\boxed{13}"], True, ["1"])
    assert row.model_answers == "13"
    row = run(spark, [CODE + ASK, BOX, "x" * 101, CODE + "x"], True, ["1"])
    assert (row.model_answers, row.gen_texts) == ("12", PROMPT + CODE + "x")
    row = run(spark, [CODE + ASK, BOX, "x" * 101, CODE + "x"], False, ["1"])
    assert (row.model_answers, row.pruned_step) == ("12", 2)


def test_a_cut_box_takes_the_answer_away(spark):
    # The backslash of an old box has just left the region, "answer is" is still inside.
    row = run(spark, [CODE + ASK, BOX, " answer is " + "y" * 80], True, ["1"])
    assert len(BOX) == 13 and row.model_answers == "-1"


def test_last_step_changes_nothing_without_an_answer(spark):
    row = run(spark, [CODE + "open end"], False)
    assert (row.should_prune, row.model_answers, row.gen_texts) == (False, "-1", PROMPT + CODE + "open end")
    row = run(spark, [CODE + ASK], True, ["1"])
    assert row.gen_texts == PROMPT + CODE + ASK


def test_output_request_missing(spark):
    assert run(spark, [CODE + "end", ""], False).pruned_step == 0
    row = run(spark, [CODE + "end", CODE + ASK, ""], True, ["1", "2"])
    assert row.gen_texts == PROMPT + CODE + ASK + "2\n```"


def test_long_output_and_missing_tables(spark):
    row = run(spark, [CODE + ASK, ""], True, ["9" * 201])
    assert row.gen_texts.endswith("9" * 200 + " ... (output truncated)\n```")
    row = run(spark, [CODE + ASK], True, num_steps=2)
    assert row.gen_texts == PROMPT + CODE + ASK + "\n```"


def test_region_size(spark):
    steps = [CODE + ASK, BOX + "z" * 20, ""]
    assert run(spark, steps, True, ["1"]).model_answers == "12"
    assert run(spark, steps, True, ["1"], region_chars=15).model_answers == "-1"


def test_pruned_traces_vote_in_the_order_they_stopped(spark):
    scored = spark.createDataFrame(
        [(1, 0, "5", None), (1, 1, "6", 2), (1, 2, "6.4", None), (1, 3, "5", 3), (2, 0, "-1", 0)],
        "problem_id long, sample_id long, model_answers string, pruned_step int",
    )
    found = {row.problem_id: row.answer for row in tracing.vote_traces(scored).collect()}
    assert found == {1: 6, 2: 0}


def test_fan_out(spark):
    problems = spark.createDataFrame([(1, "a"), (2, "b")], "problem_id long, text string")
    rows = tracing.fan_out(problems, 3).collect()
    assert sorted((r.problem_id, r.sample_id, r.text) for r in rows) == [(p, s, t) for p, t in ((1, "a"), (2, "b")) for s in range(3)]
    assert tracing.fan_out(problems).count() == 96


def test_all_steps_need_one_shuffle(spark):
    traces = spark.createDataFrame([(1, 1, PROMPT)], "problem_id long, sample_id long, text string")
    keys = "problem_id long, sample_id long, step int"
    made = spark.createDataFrame([(1, 1, 0, "x")], f"{keys}, completion string")
    ran = spark.createDataFrame([(1, 1, 0, "y")], f"{keys}, output string")
    plan = tracing.score_traces(traces, made, ran)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def plainly(prompt, completions, outputs, restart, region_chars):
    """The decision table on whole texts, step by step."""
    text, region = prompt, None
    for step, (made, ran) in enumerate(zip(completions, outputs)):
        text += made
        asks, end = text.endswith(ASK), text[-region_chars:]
        answers = not asks and ("answer is" in end or "\\boxed" in end)
        if not re.search(blocks.CODE_BLOCK, text):
            if not restart:
                return text, step, False, region
            text = prompt
        elif answers and not re.search(blocks.OUTPUT_BLOCK, text):
            return text, step, True, region
        elif answers:
            region = end
        elif step == len(completions) - 1:
            break
        elif asks:
            text += (ran if len(ran) <= 200 else ran[:200] + blocks.OUTPUT_CUT) + "\n```"
        elif restart:
            text = prompt
        else:
            return text, step, True, region
    return text, None, True, region


def test_the_fold_decides_as_on_whole_texts():
    dice, seen = random.Random(3), set()
    parts = [CODE, ASK, CODE + ASK, "```", "```python", "put\n", "```out", "`", "``", "answer is 3", "\\boxed{1}", "x" * 30, "é\n", ""]
    for _ in range(20_000):
        made = ["".join(dice.choices(parts, k=dice.randrange(4))) for _ in range(dice.randrange(9))]
        ran = [dice.choice(["", "1", "7" * 250, "``", "answer is 2", "```"]) for _ in made]
        given = (dice.choice([PROMPT, "", CODE]), made, ran, dice.random() < 0.7, dice.choice([100, 15, 5]))
        assert tracing.fold_steps(*given) == plainly(*given)
        seen.add(plainly(*given)[1:])
    assert len(seen) > 100


def test_lists_of_steps_give_the_same_as_rows(spark):
    """Lists in order, out of order, in pieces, with gaps, nulls and steps beyond the last."""
    keys = "problem_id long, sample_id long"
    traces = spark.createDataFrame([(1, i, PROMPT) for i in range(5)], f"{keys}, text string")
    whole = [(0, CODE + ASK), (1, "\n" + BOX), (2, "")]
    made = [(1, 0, whole), (1, 1, whole[::-1]), (1, 2, whole[1:]), (1, 2, whole[:1]), (1, 3, whole[:2] + [(7, "z"), (None, "z"), (2, None)])]
    made += [(1, 4, None), (1, 4, []), (1, 9, whole)]
    ran = [(1, i, [(0, f"{i}" * 60)]) for i in range(4)]

    def frames(rows, name):
        lists = spark.createDataFrame(rows, f"{keys}, steps array<struct<step:long,{name}:string>>")
        return lists, lists.select("problem_id", "sample_id", F.inline("steps"))

    (made_lists, made_rows), (ran_lists, ran_rows) = frames(made, "completion"), frames(ran, "output")
    order = ["problem_id", "sample_id"]
    lists = tracing.score_lists(traces, made_lists, ran_lists, 3).orderBy(order).collect()
    assert lists == tracing.score_traces(traces, made_rows, ran_rows, 3).orderBy(order).collect()
    assert [row.model_answers for row in lists] == ["12"] * 4 + ["-1"] and len(lists[0].gen_texts) > 100
    again = made_lists.union(made_lists.filter("sample_id = 2"))
    with pytest.raises(Exception, match="more than one row for a trace or its step: 1/2"):
        tracing.score_lists(traces, again, ran_lists, 3).collect()


def test_long_traces_take_work_in_their_length(spark):
    steps = 20_000
    traces = spark.createDataFrame([(1, 1, PROMPT)], "problem_id long, sample_id long, text string")
    numbers = traces.select("problem_id", "sample_id", F.sequence(F.lit(0), F.lit(steps - 1)).alias("step"))

    def lists(body, name):
        rows = numbers.withColumn(name, F.array_repeat(F.lit(body), steps))
        return rows.select("problem_id", "sample_id", F.arrays_zip("step", name).alias("steps"))

    row = tracing.score_lists(traces, lists(CODE + ASK, "completion"), lists("1" * 100, "output"), steps).first()
    assert row.gen_texts == PROMPT + (CODE + ASK + "1" * 100 + "\n```") * (steps - 1) + CODE + ASK


def test_live_functions_give_the_same_as_tables(spark):
    def make_generate():
        def generate(texts):
            return [("\nSo \\boxed{%d}" % len(t)) if "```output" in t else CODE + ASK for t in texts]

        return generate

    def make_execute():
        return lambda codes: [code.strip()[::-1] for code in codes]

    problems = spark.createDataFrame([(1, PROMPT), (2, PROMPT + "longer")], "problem_id long, text string")
    traces = tracing.fan_out(problems, 3).repartition(4)
    live = tracing.solve_live(traces, make_generate, make_execute, num_steps=3)
    made, ran = [], []
    for problem, prompt in ((1, PROMPT), (2, PROMPT + "longer")):
        for sample in range(3):
            text = prompt + CODE + ASK
            made.append((problem, sample, 0, CODE + ASK))
            ran.append((problem, sample, 0, "print(1)"[::-1]))
            text += "print(1)"[::-1] + "\n```"
            for step in (1, 2):
                made.append((problem, sample, step, "\nSo \\boxed{%d}" % len(text)))
                text += made[-1][-1]
    keys = "problem_id long, sample_id long, step int"
    stored = tracing.score_traces(
        traces,
        spark.createDataFrame(made, f"{keys}, completion string"),
        spark.createDataFrame(ran, f"{keys}, output string"),
        num_steps=3,
    )
    order = ["problem_id", "sample_id"]
    assert live.orderBy(order).collect() == stored.orderBy(order).collect()


def test_batches_skip_null_texts(spark):
    def make():
        def shout(texts):
            assert all(texts)
            return [text.upper() for text in texts]

        return shout

    rows = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "i int, t string").coalesce(1)
    found = rows.select("i", tracing.batched(F.col("t"), make).alias("u")).orderBy("i").collect()
    assert [row.u for row in found] == ["A", None, "B"]


def test_null_prompts_stay_and_doubled_rows_raise(spark):
    traces = spark.createDataFrame([(1, 1, None), (1, 2, "q")], "problem_id long, sample_id long, text string")
    none = spark.createDataFrame([], "problem_id long, sample_id long, step int, output string")
    one = spark.createDataFrame([(1, 1, 0, "x"), (9, 9, 0, "stray")], "problem_id long, sample_id long, step int, completion string")
    scored = {row.sample_id: row for row in tracing.score_traces(traces, one, none, 1, False).collect()}
    assert set(scored) == {1, 2} and scored[1].text == "" and scored[1].gen_texts == "x"
    with pytest.raises(Exception, match="more than one row for a trace"):
        tracing.score_traces(traces, one.union(one), none, 1).collect()
    with pytest.raises(Exception, match="more than one row for a trace"):
        tracing.score_traces(traces.union(traces), one, none, 1).collect()


def test_many_steps_plan_soon_and_follow_the_table(spark):
    """Sixty-four steps against the table applied one step after the other."""
    import time

    dice = __import__("random").Random(3)
    choices = [CODE + ASK, BOX, "The answer is 4", "text", CODE + "x", "", "z" * 120, ASK, "```output\n1\n```" + BOX]
    made, ran, expected = [], [], {}
    for sample in range(40):
        text, gen, stopped = PROMPT, PROMPT, None
        for step in range(64):
            completion, output = dice.choice(choices), str(dice.randrange(9)) * dice.choice([1, 250])
            made.append((1, sample, step, completion))
            ran.append((1, sample, step, output))
            if stopped is not None:
                continue
            gen += completion
            region = gen[-100:]
            has = lambda word: bool(__import__("re").search(f"(?s)```{word}.*?```", gen))
            states = not gen.endswith(ASK) and ("answer is" in region or "\\boxed" in region)
            if not has("python"):
                gen = text
            elif states and not has("output"):
                stopped = step
            elif states or step == 63:
                pass
            elif not gen.endswith(ASK):
                gen = text
            else:
                gen += (output if len(output) <= 200 else output[:200] + " ... (output truncated)") + "\n```"
        expected[sample] = (gen, stopped)
    keys = "problem_id long, sample_id long, step int"
    traces = spark.createDataFrame([(1, s, PROMPT) for s in range(40)], "problem_id long, sample_id long, text string")
    began = time.time()
    scored = tracing.score_traces(traces, spark.createDataFrame(made, f"{keys}, completion string"), spark.createDataFrame(ran, f"{keys}, output string"), 64)
    scored._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10
    assert {row.sample_id: (row.gen_texts, row.pruned_step) for row in scored.collect()} == expected


@pytest.mark.parametrize("records", [100, 1000])
def test_batches_have_their_own_size(spark, records, tmp_path):
    log = str(tmp_path / "sizes")

    def make():
        def note(texts):
            with open(log, "a") as out:
                out.write(f"{len(texts)}\n")
            return [text + "!" for text in texts]

        return note

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        rows = spark.range(0, 1111, 1, 1).select("id", F.when(F.col("id") % 10 != 3, F.col("id").cast("string")).alias("t"))
        found = rows.select("id", tracing.batched("t", make).alias("u")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(row.u == (None if row.id % 10 == 3 else f"{row.id}!") for row in found) and len(found) == 1111
    asked = 1111 - 111
    sizes = [int(line) for line in open(log)]
    assert sizes == [128] * (asked // 128) + [asked % 128]


def test_a_wrong_number_of_replies_raises(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "i int, t string").coalesce(1)
    with pytest.raises(Exception, match="1 replies to 2 texts"):
        rows.select(tracing.batched("t", lambda: lambda texts: texts[:1])).collect()


def test_replies_as_a_stage_of_their_own(spark):
    def make():
        return lambda texts: [f"{text}/{len(texts)}" for text in texts]

    rows = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t"), F.lit(1.5).alias("u"))
    found = tracing.with_replies(rows, "t", "reply", make, 64)
    assert found.columns == ["id", "t", "u", "reply"]
    replies = [row.reply for row in found.orderBy("id").collect()]
    assert [r for i, r in enumerate(replies) if i % 3 == 0] == [None] * 100
    sizes = [64] * 192 + [8] * 8
    assert [r for r in replies if r] == [f"{i}/{n}" for i, n in zip((i for i in range(300) if i % 3), sizes)]
