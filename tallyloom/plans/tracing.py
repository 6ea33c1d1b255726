"""Scoring candidate traces step by step.

What a model wrote and what its programs printed come in as tables:

* ``generations``: problem_id, sample_id, step, completion
* ``executions``: problem_id, sample_id, step, output

or, with several steps of a trace in a row, ``steps`` as an array of (step,
completion) or (step, output). All steps of a trace are brought into one row by
a single shuffle; the decision table is then folded over its steps, row by row,
so a plan is as large for 64 steps as for four. The fold runs in Python on Arrow
batches: it looks at the end of a text and at what a step adds, so its work is
linear in the length of a trace, and a column function would copy its state at
every step.
Answers are cleaned once at the end, since only the last one of a trace counts.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.answers import NO_ANSWER, boxed_answer, numeric_answer, with_clean_answer
from ..functions.blocks import (
    ANSWER_MARKS,
    BLOCK_END,
    CODE_BLOCK,
    OUTPUT_BLOCK,
    OUTPUT_CHARS,
    OUTPUT_CUT,
    OUTPUT_REQUEST,
    REGION_CHARS,
    answer_region,
    append_output,
    asks_for_output,
    has_code_block,
    has_output_block,
    last_code_block,
    mentions_box,
    states_answer,
)
from ..operators.votes import majority_vote
from ..session import settle

TRACE = ["problem_id", "sample_id"]
STATE = [*TRACE, "text", "gen_texts", "should_prune", "model_answers", "has_code", "pruned_step"]

# Candidates per problem and steps per candidate.
NUM_SAMPLES = 48
NUM_STEPS = 4
# Fixed value: texts that a model is given at once.
BATCH_SIZE = 128

# A batch of texts to a batch of texts; made once per Python worker task.
BatchFunction = Callable[[list[str]], list[str]]


def fan_out(problems: DataFrame, num_samples: int = NUM_SAMPLES) -> DataFrame:
    """``num_samples`` equal traces per problem (``problem_id``, ``text``)."""
    samples = F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1)).cast("array<bigint>"))
    return problems.select("problem_id", samples.alias("sample_id"), "text")


def gather_steps(traces: DataFrame, generations: DataFrame, executions: DataFrame, num_steps: int) -> DataFrame:
    """One row per trace: its prompt ``text`` and ``steps``, an array of (step, completion, output) from step 0.

    The three tables are stacked and shuffled once on the trace key, which
    spreads even a problem with most of the rows. A hash of the key leads the
    grouping: Spark sorts by the first column first, and a problem with most of
    the rows would make all its comparisons ties.

    A null prompt is an empty one. Two rows for one trace, or two completions
    or outputs for one step of it, raise. Completions and outputs of traces
    that are not in ``traces``, or of steps beyond ``num_steps``, are left out.
    """
    inside = F.col("step").between(0, num_steps - 1)

    def lists(df: DataFrame, body: str) -> DataFrame:
        return df.filter(inside).select(*TRACE, F.array(F.struct("step", body)).alias("steps"))

    return gather_lists(traces, lists(generations, "completion"), lists(executions, "output"), num_steps)


def gather_lists(traces: DataFrame, generations: DataFrame, executions: DataFrame, num_steps: int) -> DataFrame:
    """``gather_steps`` of tables with any number of steps of a trace in a row.

    Their ``steps`` is an array of (step, completion) or (step, output).
    """
    numbers = F.sequence(F.lit(0), F.lit(num_steps - 1)) if num_steps else F.array().cast("array<int>")

    def entries(df: DataFrame, name: str, kind: str) -> DataFrame:
        steps = F.col("steps")
        lists = F.struct(steps["step"].try_cast("array<int>").alias("steps"), steps[name].alias("bodies"))
        return df.filter(steps.isNotNull()).select(*TRACE, lists.alias(kind))

    stacked = (
        traces.select(*TRACE, F.struct("text").alias("prompt"))
        .unionByName(entries(generations, "completion", "made"), allowMissingColumns=True)
        .unionByName(entries(executions, "output", "ran"), allowMissingColumns=True)
        .withColumn("__trace", F.xxhash64(*TRACE))
        .repartition("__trace")
    )
    gathered = stacked.groupBy("__trace", *TRACE).agg(*[F.collect_list(kind).alias(kind) for kind in ("prompt", "made", "ran")])
    known = gathered.filter(F.array_size("prompt") > 0).select(
        *TRACE, "prompt", *[F.flatten(F.col(kind)[name]).alias(f"{kind}_{name}") for kind in ("made", "ran") for name in ("steps", "bodies")]
    )

    def whole(kind: str) -> Column:
        return F.col(f"{kind}_steps") == numbers

    def once(kind: str) -> Column:
        inside = F.filter(f"{kind}_steps", lambda step: step.between(0, num_steps - 1))
        return whole(kind) | (F.array_size(F.array_distinct(inside)) == F.array_size(inside))

    def aligned(kind: str) -> Column:
        """Bodies from step 0 on, null where one is missing; those of a whole list in order are so already."""

        def body_at(step: Column) -> Column:
            return F.get(f"{kind}_bodies", F.array_position(f"{kind}_steps", step).cast("int") - 1)

        return F.when(whole(kind), F.col(f"{kind}_bodies")).otherwise(F.transform(numbers, body_at))

    twice = F.concat(F.lit("more than one row for a trace or its step: "), F.concat_ws("/", *TRACE))
    text = F.when(
        (F.array_size("prompt") == 1) & once("made") & once("ran"), F.coalesce(F.get("prompt", F.lit(0))["text"], F.lit(""))
    ).otherwise(F.raise_error(twice).cast("string"))
    steps = F.arrays_zip(numbers, aligned("made"), aligned("ran")).cast("array<struct<step:int,completion:string,output:string>>")
    return known.select(*TRACE, text.alias("text"), steps.alias("steps"))


def _start(text: Column) -> dict[str, Column]:
    """State of a trace before its first step."""
    return {
        "gen_texts": text,
        "pruned_step": F.lit(None).cast("int"),
        "has_code": F.lit(True),
        "answer_region": F.lit(None).cast("string"),
    }


def start(traces: DataFrame) -> DataFrame:
    return traces.withColumns(_start(F.col("text")))


def _state() -> dict[str, Column]:
    return {name: F.col(name) for name in ("text", "gen_texts", "pruned_step", "has_code", "answer_region")}


def longer_text(completion: Column, state: Mapping[str, Column]) -> Column:
    """The text of a trace with the completion of this step; stopped traces keep theirs."""
    longer = F.concat(state["gen_texts"], F.coalesce(completion, F.lit("")))
    return F.when(state["pruned_step"].isNull(), longer).otherwise(state["gen_texts"])


def verdict(
    last_step: bool | Column, restart_on_fail: bool, state: Mapping[str, Column], region_chars: int = REGION_CHARS
) -> Column:
    """What this step does to the trace; the first rule that fits wins."""
    text = state["gen_texts"]
    asks = asks_for_output(text)
    answers = ~asks & states_answer(answer_region(text, region_chars))
    return (
        F.when(state["pruned_step"].isNotNull(), "over")
        .when(~has_code_block(text), "restart" if restart_on_fail else "no_code")
        .when(answers & ~has_output_block(text), "prune")
        .when(answers, "answer")
        .when(F.lit(last_step) if isinstance(last_step, bool) else last_step, "keep")
        .when(~asks, "restart" if restart_on_fail else "prune")
        .otherwise("execute")
    )


def next_state(
    step: int | Column, found: Column, output: Column, state: Mapping[str, Column], region_chars: int = REGION_CHARS
) -> dict[str, Column]:
    """Columns that carry out the verdict ``found``. An answered trace stays alive and may change its answer."""
    text, number = state["gen_texts"], F.lit(step) if isinstance(step, int) else step
    return {
        "gen_texts": F.when(found == "restart", state["text"])
        .when(found == "execute", append_output(text, F.coalesce(output, F.lit(""))))
        .otherwise(text),
        "pruned_step": F.when(found.isin("prune", "no_code"), number).otherwise(state["pruned_step"]),
        "has_code": state["has_code"] & (found != "no_code"),
        "answer_region": F.when(found == "answer", answer_region(text, region_chars)).otherwise(state["answer_region"]),
    }


_CODED, _SHOWN = re.compile(CODE_BLOCK).search, re.compile(OUTPUT_BLOCK).search


def _states(region: str) -> bool:
    return ANSWER_MARKS[0] in region or ANSWER_MARKS[1] in region


def fold_steps(
    prompt: str, completions: list[str | None], outputs: list[str | None], restart_on_fail: bool, region_chars: int = REGION_CHARS
) -> tuple[str, int | None, bool, str | None]:
    """The rules of ``verdict`` and ``next_state`` taken through all steps: gen_texts, pruned_step, has_code, answer_region.

    A text without a code block does not outlive its step, one that states an
    answer without an output block neither. So each block is searched for until
    it is found, and holds until a restart.
    """
    chars = max(region_chars, len(OUTPUT_REQUEST))
    pieces, tail, coded, shown, region = [prompt], prompt[-chars:], False, False, None
    last = len(completions) - 1
    for step, made in enumerate(completions):
        made = made or ""
        pieces.append(made)
        tail = (tail + made)[-chars:]
        if not coded:
            coded = _CODED("".join(pieces)) is not None
            if not coded and not restart_on_fail:
                return "".join(pieces), step, False, region
        asks = tail.endswith(OUTPUT_REQUEST)
        if coded and not asks and _states(end := tail[max(0, len(tail) - region_chars) :]):
            shown = shown or _SHOWN("".join(pieces)) is not None
            if not shown:
                return "".join(pieces), step, True, region
            region = end
        elif coded and step == last:
            break
        elif coded and asks:
            output = outputs[step] or ""
            added = (output if len(output) <= OUTPUT_CHARS else output[:OUTPUT_CHARS] + OUTPUT_CUT) + BLOCK_END
            pieces.append(added)
            tail = (tail + added)[-chars:]
        elif restart_on_fail:
            pieces, tail, coded, shown = [prompt], prompt[-chars:], False, False
        else:
            return "".join(pieces), step, True, region
    return "".join(pieces), None, True, region


# Traces whose steps are Python strings at a time.
_FOLD_ROWS = 256


def _with_final_state(gathered: DataFrame, restart_on_fail: bool, region_chars: int) -> DataFrame:
    """Traces and their ``text`` with the columns of ``fold_steps`` instead of ``steps``."""
    state = [("gen_texts", StringType()), ("pruned_step", IntegerType()), ("has_code", BooleanType()), ("answer_region", StringType())]
    types = [pa.string(), pa.int32(), pa.bool_(), pa.string()]
    kept = gathered.select(*TRACE, "text").schema

    def fold(part: pa.RecordBatch) -> pa.RecordBatch:
        prompts, lists = part.column("text").to_pylist(), [part.column(name) for name in ("completion", "output")]
        made, ran = (bodies.flatten().to_numpy(zero_copy_only=False).tolist() for bodies in lists)
        found, at = [], 0
        for prompt, n in zip(prompts, pc.list_value_length(lists[0]).to_pylist()):
            found.append(fold_steps(prompt, made[at : at + n], ran[at : at + n], restart_on_fail, region_chars))
            at += n
        values = [pa.array(list(column), kind) for column, kind in zip(zip(*found), types)]
        return pa.RecordBatch.from_arrays([*map(part.column, kept.names), *values], [*kept.names, *(name for name, _ in state)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FOLD_ROWS):
                yield fold(batch.slice(at, _FOLD_ROWS))

    rows = gathered.select(*kept.names, *[F.col("steps")[name].alias(name) for name in ("completion", "output")])
    return rows.mapInArrow(run, StructType(kept.fields + [StructField(name, kind) for name, kind in state]))


def read_answers(df: DataFrame) -> DataFrame:
    """Add ``model_answers`` (``"-1"`` without answer) and ``should_prune``.

    A region that speaks of a box counts only what the box holds.
    """
    region = F.col("answer_region")
    stated = F.when(mentions_box(region), boxed_answer(region)).otherwise(region)
    df = with_clean_answer(df, stated, "model_answers")
    return df.withColumns(
        {
            "model_answers": F.coalesce("model_answers", F.lit(NO_ANSWER)),
            "should_prune": F.col("pruned_step").isNotNull(),
        }
    ).drop("answer_region")


def score_traces(
    traces: DataFrame,
    generations: DataFrame,
    executions: DataFrame,
    num_steps: int = NUM_STEPS,
    restart_on_fail: bool = True,
    region_chars: int = REGION_CHARS,
) -> DataFrame:
    """Final state of every trace (problem_id, sample_id, text).

    A missing completion or output counts as empty. The prompts in ``traces``
    are shuffled along, which is cheap next to the completions.
    """
    return score_steps(gather_steps(traces, generations, executions, num_steps), restart_on_fail, region_chars)


def score_lists(
    traces: DataFrame,
    generations: DataFrame,
    executions: DataFrame,
    num_steps: int = NUM_STEPS,
    restart_on_fail: bool = True,
    region_chars: int = REGION_CHARS,
) -> DataFrame:
    """``score_traces`` of tables with any number of steps of a trace in a row."""
    return score_steps(gather_lists(traces, generations, executions, num_steps), restart_on_fail, region_chars)


def score_steps(gathered: DataFrame, restart_on_fail: bool = True, region_chars: int = REGION_CHARS) -> DataFrame:
    """Final state of traces whose steps are in their row, as ``gather_steps`` returns them."""
    scored = _with_final_state(gathered, restart_on_fail, region_chars)
    return read_answers(scored).select(*STATE)


def vote_traces(scored: DataFrame, num_steps: int = NUM_STEPS, problems: DataFrame | None = None) -> DataFrame:
    """Majority answer per problem. Pruned traces vote too, in the order they stopped."""
    candidates = scored.select(
        *TRACE,
        F.coalesce("pruned_step", F.lit(num_steps)).alias("stopped"),
        numeric_answer("model_answers").alias("candidate"),
    )
    return majority_vote(candidates, "problem_id", "candidate", ["stopped", "sample_id"], problems)


def in_batches(texts: Iterable[pd.Series], size: int) -> Iterator[list[str]]:
    """Runs of exactly ``size`` texts, fewer at the end only, from series of any lengths; nulls are passed over."""
    held: list[str] = []
    for series in texts:
        held += series[series.notna()].tolist()
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def _answered(
    parts: Iterator[tuple[Any, pd.Series]], function: BatchFunction, batch_size: int
) -> Iterator[tuple[Any, pd.Series]]:
    """Replies to the texts of every part, each with what came along with it; parts wait until their texts are answered."""
    waiting: deque[tuple[Any, pd.Series]] = deque()
    replies: deque[str] = deque()

    def passed() -> Iterator[pd.Series]:
        for part in parts:
            waiting.append(part)
            yield part[1]

    def ready() -> Iterator[tuple[Any, pd.Series]]:
        while waiting and waiting[0][1].notna().sum() <= len(replies):
            along, texts = waiting.popleft()
            asked = texts.index[texts.notna()]
            found = [replies.popleft() for _ in asked]
            yield along, pd.Series(found, index=asked, dtype=object).reindex(texts.index)

    for asked in in_batches(passed(), batch_size):
        given = list(function(asked))
        if len(given) != len(asked):
            raise ValueError(f"{len(given)} replies to {len(asked)} texts")
        replies.extend(given)
        yield from ready()
    yield from ready()


def batched(text: Column | str, make: Callable[[], BatchFunction], batch_size: int = BATCH_SIZE) -> Column:
    """Apply a user function to batches of texts; null texts are skipped.

    ``make`` runs once per task, so it can load a model. The function sees
    ``batch_size`` texts at a time, fewer only at the end of a task, whatever
    size the Arrow batches have (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    It has to give one reply per text.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, replies in _answered(((None, texts) for texts in batches), make(), batch_size):
            yield replies

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def with_replies(
    df: DataFrame,
    text: str,
    target: str,
    make: Callable[[], BatchFunction],
    batch_size: int = BATCH_SIZE,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``df`` with the column ``target``: the replies of ``batched``, in a stage with resources of its own.

    ``profile`` may ask for accelerators or memory that only this stage needs;
    the cluster has to support stage-level scheduling then. All columns of the
    rows pass through the Python workers, so select the needed ones before.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, replies in _answered(((frame, frame[text]) for frame in frames), make(), batch_size):
            frame[target] = replies
            yield frame

    schema = StructType([field for field in df.schema.fields if field.name != target] + [StructField(target, StringType())])
    return df.mapInPandas(run, schema, profile=profile)


def solve_live(
    traces: DataFrame,
    make_generate: Callable[[], BatchFunction],
    make_execute: Callable[[], BatchFunction],
    num_steps: int = NUM_STEPS,
    restart_on_fail: bool = True,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Score traces with user functions instead of stored tables.

    ``make_generate`` continues texts, ``make_execute`` turns the last code
    block of a trace to its output. Traces never leave their partition. A
    sampled completion cannot be repeated, so every step is stored.
    """
    df = start(traces)
    for step in range(num_steps):
        last_step = step == num_steps - 1
        live = F.when(F.col("pruned_step").isNull(), F.col("gen_texts"))
        df = settle(df.withColumn("completion", batched(live, make_generate, batch_size)))
        df = df.withColumn("gen_texts", longer_text(F.col("completion"), _state()))
        df = df.withColumn("verdict", verdict(last_step, restart_on_fail, _state()))
        if last_step:
            df = df.withColumn("output", F.lit(None).cast("string"))
        else:
            code = F.when(F.col("verdict") == "execute", last_code_block("gen_texts"))
            df = settle(df.withColumn("output", batched(code, make_execute, batch_size)))
        df = df.withColumns(next_state(step, F.col("verdict"), F.col("output"), _state()))
    return read_answers(df).select(*STATE)
