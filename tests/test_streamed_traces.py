import random

import pytest

from tallyloom.plans import inputs, tracing
from tallyloom.streaming.incremental import open_stream
from tallyloom.streaming.traces import scored_so_far, start_scoring, step_stream, votes_so_far, whole_traces

KEYS = "problem_id long, sample_id long"
KINDS = {"prompts": f"{KEYS}, text string", "generations": f"{KEYS}, step int, completion string", "executions": f"{KEYS}, step int, output string"}


def streams(spark, home, max_files=1):
    return step_stream(*[open_stream(spark, schema, f"{home}/{kind}", max_files) for kind, schema in KINDS.items()])


def write(spark, home, kind, rows):
    spark.createDataFrame(rows, KINDS[kind]).coalesce(1).write.mode("append").parquet(f"{home}/{kind}")


def score(spark, home, progress="progress"):
    start_scoring(streams(spark, home), f"{home}/scored", f"{home}/{progress}").awaitTermination()
    return sorted(map(tuple, scored_so_far(spark, f"{home}/scored").collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, folder):
    def rows(df, columns):
        return sorted(map(tuple, df.filter("sample_id < 60").select(columns).collect()))

    return {
        "prompts": rows(inputs.traces(spark, folder), ["problem_id", "sample_id", "text"]),
        "generations": rows(inputs.generations(spark, folder), ["problem_id", "sample_id", "step", "completion"]),
        "executions": rows(inputs.executions(spark, folder), ["problem_id", "sample_id", "step", "output"]),
    }


@pytest.fixture(scope="module")
def expected(spark, tables):
    frames = [spark.createDataFrame(tables[kind], schema) for kind, schema in KINDS.items()]
    scored = tracing.score_traces(*frames)
    return sorted(map(tuple, scored.collect()), key=str), sorted(map(tuple, tracing.vote_traces(scored).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_into_files_gives_the_batch_result(spark, tables, expected, tmp_path, seed):
    dice, home = random.Random(seed), str(tmp_path)
    for kind, rows in tables.items():
        rows = dice.sample(rows, len(rows))
        cuts = sorted(dice.randrange(len(rows)) for _ in range(dice.randrange(1, 4)))
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            write(spark, home, kind, rows[a:b] + dice.choices(rows, k=5))  # some come again
    assert score(spark, home) == expected[0]
    assert sorted(map(tuple, votes_so_far(spark, f"{home}/scored").collect())) == expected[1]


def test_late_rows_finish_traces_and_repeats_change_nothing(spark, tables, expected, tmp_path):
    home = str(tmp_path)
    late = {kind: rows[::3] for kind, rows in tables.items()}
    for kind, rows in tables.items():
        write(spark, home, kind, [row for row in rows if row not in set(late[kind])])
    early = score(spark, home)
    whole = {row[:2] for row in tables["prompts"]} - {row[:2] for rows in late.values() for row in rows}
    assert {row[:2] for row in early} == whole
    for kind, rows in late.items():
        write(spark, home, kind, rows)
    assert score(spark, home) == expected[0]
    for kind, rows in tables.items():
        write(spark, home, kind, rows)
    assert score(spark, home) == expected[0]
    # All files again as a new run: its batches write their own folders over.
    assert sorted(set(score(spark, home, "fresh"))) == sorted(set(expected[0]))


def test_two_different_rows_for_a_step_raise(spark, tmp_path):
    home = str(tmp_path)
    write(spark, home, "prompts", [(1, 1, "p")])
    write(spark, home, "generations", [(1, 1, 0, "a")])
    write(spark, home, "generations", [(1, 1, 0, "b")])
    write(spark, home, "executions", [(1, 1, 0, "")])
    with pytest.raises(Exception, match="two different rows for one step"):
        score(spark, home)


def test_nothing_has_arrived(spark, tmp_path):
    for kind in KINDS:
        (tmp_path / kind).mkdir()
    assert score(spark, str(tmp_path)) == []
    assert whole_traces(streams(spark, str(tmp_path))).isStreaming


def test_open_traces_and_marks_are_tables(spark, tmp_path):
    """What a batch leaves: the entries of open traces, and nothing but the mark of those that are over."""
    home = str(tmp_path)
    whole = {"prompts": [(1, 1, "p")], "generations": [(1, 1, i, f"c{i}") for i in range(4)], "executions": [(1, 1, i, "") for i in range(4)]}
    for kind, rows in whole.items():
        write(spark, home, kind, rows + [(1, 2, *row[2:]) for row in rows[:3]] + [(1, 1, *row[2:]) for row in rows])
    assert [row[:2] for row in score(spark, home)] == [(1, 1)]
    last = max(int(path.name.partition("=")[2]) for path in tmp_path.glob("progress-traces/batch=*"))
    kept = spark.read.parquet(f"{home}/progress-traces/batch={last}").orderBy("sample_id").collect()
    assert [(row.sample_id, row.over, len(row.entries)) for row in kept] == [(1, True, 0), (2, False, 7)]
    # A trace that is over takes no rows, the other one is finished by its last two.
    write(spark, home, "generations", [(1, 1, 0, "late"), (1, 2, 3, "c3"), (1, 2, 9, "beyond")])
    write(spark, home, "executions", [(1, 2, 3, "")])
    assert [row[:2] for row in score(spark, home)] == [(1, 1), (1, 2)]
