"""Traces scored while their steps arrive: completions and outputs in any files, late and out of order.

Three folders are followed as one stream: prompts, completions, outputs. What
has arrived of a trace is kept; when its prompt and every step are there, it
leaves as one row, once, and only a mark stays that it is over. Rows that come
again change nothing. ``start_scoring`` keeps both as tables next to its
checkpoint, so a micro-batch is one shuffle and no trace passes through Python
for its state; ``whole_traces`` keeps them in the state of a stream that goes on
elsewhere. The decision table runs on the finished rows by the same functions as
in a batch, and results are stored per micro-batch: a repeated batch writes its
own folders again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.tracing import NUM_STEPS, STATE, TRACE, score_steps, vote_traces
from .incremental import finished

_GATHERED = "problem_id {problem}, sample_id {sample}, text string, steps array<struct<step:int,completion:string,output:string>>"
_STATE = "over boolean, text string, completions array<string>, outputs array<string>"
_SCORED = (
    "problem_id long, sample_id long, text string, gen_texts string, should_prune boolean,"
    " model_answers string, has_code boolean, pruned_step int"
)
PROMPT, COMPLETION, OUTPUT = "prompt", "completion", "output"


def step_stream(prompts: DataFrame, generations: DataFrame, executions: DataFrame) -> DataFrame:
    """The three streams as one: trace key, ``kind``, ``step``, ``body``."""

    def rows(df: DataFrame, kind: str, step: Column, body: str) -> DataFrame:
        return df.select(*TRACE, F.lit(kind).alias("kind"), step.cast("int").alias("step"), F.coalesce(body, F.lit("")).alias("body"))

    return (
        rows(prompts, PROMPT, F.lit(0), "text")
        .unionByName(rows(generations, COMPLETION, F.col("step"), "completion"))
        .unionByName(rows(executions, OUTPUT, F.col("step"), "output"))
    )


def _kept(old: str | None, new: str, key: tuple) -> str:
    if old is not None and old != new:
        raise ValueError(f"two different rows for one step of the trace {key}")
    return new


def whole_traces(stream: DataFrame, num_steps: int = NUM_STEPS) -> DataFrame:
    """One row per trace, when all of it has arrived: its key, ``text`` and ``steps``.

    A trace is whole with its prompt and, for every step, its completion and its
    output; producers send an empty output where nothing ran. Two different
    rows for one step raise, equal ones count once. Rows of other steps are
    passed over.
    """
    schema = stream.schema
    kinds = {"problem": schema["problem_id"].dataType.simpleString(), "sample": schema["sample_id"].dataType.simpleString()}

    def gather(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, text, completions, outputs = state.get if state.exists else (False, None, [None] * num_steps, [None] * num_steps)
        completions, outputs = list(completions or ()), list(outputs or ())
        for frame in batches:
            if over:
                continue
            for kind, step, body in zip(frame["kind"], frame["step"], frame["body"]):
                if kind == PROMPT:
                    text = _kept(text, body, key)
                elif 0 <= step < num_steps:
                    own = completions if kind == COMPLETION else outputs
                    own[step] = _kept(own[step], body, key)
        if over:
            return
        if text is not None and None not in completions and None not in outputs:
            # Nothing but the mark stays of it.
            state.update((True, None, [], []))
            steps = [{"step": i, "completion": c, "output": o} for i, (c, o) in enumerate(zip(completions, outputs))]
            yield pd.DataFrame({"problem_id": [key[0]], "sample_id": [key[1]], "text": [text], "steps": [steps]})
        else:
            state.update((False, text, completions, outputs))

    return stream.groupBy(*TRACE).applyInPandasWithState(
        gather, _GATHERED.format(**kinds), _STATE, "append", GroupStateTimeout.NoTimeout
    )


def _gathered(rows: DataFrame, num_steps: int) -> DataFrame:
    """One row per trace: its key, ``over``, ``entries`` (kind, step, body) without repeats.

    ``rows`` have a trace's mark and what is kept and new of it, as lists of
    entries. Two different entries for one step of a trace that is not over raise.
    """
    kept = rows.withColumn("__trace", F.xxhash64(*TRACE)).repartition("__trace").groupBy("__trace", *TRACE)
    found = kept.agg(F.max("over").alias("over"), F.flatten(F.collect_list("entries")).alias("entries"))

    def place(e: Column) -> Column:
        kind = F.when(e["kind"] == PROMPT, 0).when(e["kind"] == COMPLETION, 1).otherwise(2)
        return e["step"].cast("long") * 3 + kind

    # Places are whole numbers, which are told apart faster than texts; most traces have no repeats.
    places = F.array_size(F.array_distinct(F.transform("entries", place)))
    found = found.withColumn("places", places).withColumn(
        "entries", F.when(F.col("places") == F.array_size("entries"), F.col("entries")).otherwise(F.array_distinct("entries"))
    )
    twice = F.concat(F.lit("two different rows for one step of the trace "), F.concat_ws("/", *TRACE))
    once = F.col("over") | (F.col("places") == F.array_size("entries"))
    entries = F.when(once, F.col("entries")).otherwise(F.raise_error(twice).cast(found.schema["entries"].dataType))
    whole = ~F.col("over") & (F.array_size("entries") == 2 * num_steps + 1)
    return found.select(*TRACE, "over", entries.alias("entries")).withColumn("whole", whole)


def _finished_rows(whole: DataFrame, num_steps: int) -> DataFrame:
    """Whole traces as ``score_steps`` takes them."""

    def bodies(kind: str) -> Column:
        own = F.array_sort(F.filter("entries", lambda e: e["kind"] == kind))
        return own["body"]

    numbers = F.sequence(F.lit(0), F.lit(num_steps - 1)) if num_steps else F.array().cast("array<int>")
    steps = F.arrays_zip(numbers, bodies(COMPLETION), bodies(OUTPUT)).cast("array<struct<step:int,completion:string,output:string>>")
    return whole.select(*TRACE, F.get(bodies(PROMPT), F.lit(0)).alias("text"), steps.alias("steps"))


def start_scoring(
    stream: DataFrame, out: str, checkpoint: str, num_steps: int = NUM_STEPS, restart_on_fail: bool = True
) -> StreamingQuery:
    """Score every trace as it becomes whole and store it below ``out``, one folder per micro-batch.

    Below ``<checkpoint>-traces`` every batch leaves the traces that are still
    open and the keys of all that are over; the next batch reads those of the
    batch before, so a repeated one finds what it found the first time.
    """
    kept = f"{checkpoint}-traces"
    inside = (F.col("kind") == PROMPT) | F.col("step").between(0, num_steps - 1)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        entry = F.struct("kind", "step", "body")
        new = batch.filter(inside).select(*TRACE, F.lit(False).alias("over"), F.array(entry).alias("entries"))
        before = f"{kept}/batch={batch_id - 1}"
        rows = new if batch_id == 0 else new.unionByName(spark.read.schema(new.schema).parquet(before))
        path = f"{kept}/gathered={batch_id}"
        _gathered(rows, num_steps).write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
        score_steps(_finished_rows(found.filter("whole"), num_steps), restart_on_fail).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        over = F.col("over") | F.col("whole")
        # Nothing but the mark stays of what is over.
        entries = F.when(over, F.array().cast(found.schema["entries"].dataType)).otherwise(F.col("entries"))
        found.select(*TRACE, over.alias("over"), entries.alias("entries")).write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def scored_so_far(spark: SparkSession, out: str) -> DataFrame:
    """All traces stored so far; none before the first batch."""
    folders = finished(spark, out)
    if not folders:
        return spark.createDataFrame([], _SCORED)
    return spark.read.parquet(*folders).select(*STATE)


def votes_so_far(spark: SparkSession, out: str, num_steps: int = NUM_STEPS, problems: DataFrame | None = None) -> DataFrame:
    """Majority answers over all traces stored so far."""
    return vote_traces(scored_so_far(spark, out), num_steps, problems)
