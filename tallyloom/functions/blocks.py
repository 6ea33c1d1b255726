"""Code and output blocks inside a generated trace, and execution output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_column, strip

# Fences, the marker that asks for execution, limits, marks of an answer, blocked libraries.
CODE_BLOCK = r"(?s)```python(.*?)```"
OUTPUT_BLOCK = r"(?s)```output(.*?)```"
OUTPUT_REQUEST = "```output\n"
BLOCK_END = "\n```"
REGION_CHARS = 100
OUTPUT_CHARS = 200
OUTPUT_CUT = " ... (output truncated)"
ANSWER_MARKS = ["answer is", r"\boxed"]
BLOCKED_LIBRARIES = ["subprocess", "venv"]


def code_block_count(text: Column | str) -> Column:
    return F.regexp_count(as_column(text), F.lit(CODE_BLOCK))


def output_block_count(text: Column | str) -> Column:
    return F.regexp_count(as_column(text), F.lit(OUTPUT_BLOCK))


def has_code_block(text: Column | str) -> Column:
    """Stops at the first block instead of listing all of them."""
    return as_column(text).rlike(CODE_BLOCK)


def has_output_block(text: Column | str) -> Column:
    return as_column(text).rlike(OUTPUT_BLOCK)


def last_code_block(text: Column | str) -> Column:
    """Content of the last closed code block, or null."""
    blocks = F.regexp_extract_all(as_column(text), F.lit(CODE_BLOCK), F.lit(1))
    return F.try_element_at(blocks, F.lit(-1))


def uses_blocked_library(code: Column | str) -> Column:
    code = as_column(code)
    first, second = (F.contains(code, F.lit(name)) for name in BLOCKED_LIBRARIES)
    return first | second


def answer_region(text: Column | str, chars: int = REGION_CHARS) -> Column:
    """The end of the trace, the only part searched for an answer."""
    return F.right(as_column(text), F.lit(chars))


def asks_for_output(text: Column | str) -> Column:
    return F.endswith(as_column(text), F.lit(OUTPUT_REQUEST))


def states_answer(region: Column | str) -> Column:
    region = as_column(region)
    first, second = (F.contains(region, F.lit(mark)) for mark in ANSWER_MARKS)
    return first | second


def mentions_box(region: Column | str) -> Column:
    return F.contains(as_column(region), F.lit("boxed"))


def shorten_output(output: Column | str, limit: int = OUTPUT_CHARS) -> Column:
    output = as_column(output)
    cut = F.concat(F.left(output, F.lit(limit)), F.lit(OUTPUT_CUT))
    return F.when(F.length(output) > limit, cut).otherwise(output)


def append_output(text: Column | str, output: Column | str) -> Column:
    return F.concat(as_column(text), shorten_output(output), F.lit(BLOCK_END))


def with_compact_traceback(df: DataFrame, stderr: str, script: Column | str, target: str) -> DataFrame:
    """Add ``target``: the lines of an error report that say what went wrong.

    Kept are the lines with the word Traceback, the lines equal to the last
    one, the lines naming the script (cut at its path), and after each of the
    latter the next line that is none of the former. That next line is found
    by pairing every remaining line with its predecessor, so the work stays
    linear in the number of lines.
    """
    script = as_column(script)
    always, located, other = 0, 1, 2

    def tag(line: Column, at: Column) -> Column:
        spot = F.locate('"/', line)
        path = F.substr(line, spot + 1)
        cut = F.when(spot > 0, F.replace(line, path, F.lit(""))).otherwise(F.lit(""))
        kind = (
            F.when(F.contains(line, F.lit("Traceback")) | (line == F.col("__last")), always)
            .when(F.contains(line, script), located)
            .otherwise(other)
        )
        shown = F.when(kind == located, cut).otherwise(line)
        return F.struct(at.alias("at"), kind.alias("kind"), shown.alias("line"))

    entry = "struct<at:int,kind:int,line:string>"
    return (
        df.withColumn("__lines", F.split(strip(stderr), "\n"))
        .withColumn("__last", F.element_at("__lines", -1))
        .withColumn("__tagged", F.transform("__lines", tag))
        .withColumn("__rest", F.filter("__tagged", lambda e: e["kind"] != always))
        .withColumn(
            "__kept",
            F.zip_with(
                "__rest",
                F.concat(F.array(F.lit(None).cast(entry)), "__rest"),
                lambda e, before: F.when((e["kind"] == located) | (before["kind"] == located), e),
            ),
        )
        .withColumn(
            "__kept",
            F.array_sort(
                F.concat(
                    F.filter("__tagged", lambda e: e["kind"] == always),
                    F.filter("__kept", lambda e: e.isNotNull()),
                )
            ),
        )
        .withColumn(target, strip(F.array_join(F.transform("__kept", lambda e: e["line"]), "\n")))
        .drop("__lines", "__last", "__tagged", "__rest", "__kept")
    )


def with_execution_text(
    df: DataFrame, stdout: str, success: str, stderr: str, script: Column | str, target: str
) -> DataFrame:
    """Add ``target``: what a finished run shows to the trace.

    A successful run shows its trimmed output, a failed one its compact
    traceback.
    """
    df = with_compact_traceback(df, stderr, script, "__report")
    shown = F.when(F.col(success), strip(stdout)).otherwise(F.col("__report"))
    return df.withColumn(target, shown).drop("__report")
