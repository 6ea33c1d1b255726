import random

from tallyloom.functions.answers import numeric_answer
from tallyloom.operators.votes import majority_vote
from tallyloom.streaming.incremental import current_votes, finished, merge_batches, open_stream, start_tally

SCHEMA = "p long, i long, a string"


def feed(spark, source, out, progress, merge_every=50):
    stream = open_stream(spark, SCHEMA, source, max_files=1)
    query = start_tally(
        stream, lambda batch: batch.withColumn("n", numeric_answer("a")), out, progress, "p", "n", "i", merge_every
    )
    query.awaitTermination()
    return {row.p: row.answer for row in current_votes(spark, out, "p", "n").collect()}


def test_votes_over_files_match_the_batch_result(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    dice = random.Random(4)
    rows = [(dice.choice([0, dice.randrange(9)]), i, dice.choice(["-1", "2.5", "3", "1e3"])) for i in range(600)]
    dice.shuffle(rows)

    def expected(part):
        df = spark.createDataFrame(part, SCHEMA).withColumn("n", numeric_answer("a"))
        return {row.p: row.answer for row in majority_vote(df, "p", "n", ["i"]).collect()}

    # The candidates of every problem are spread over all files.
    for at in range(0, 400, 100):
        spark.createDataFrame(rows[at : at + 100], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert feed(spark, source, out, progress) == expected(rows[:400])
    spark.createDataFrame(rows[400:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert feed(spark, source, out, progress) == expected(rows)
    assert feed(spark, source, out, progress) == expected(rows)
    # A run that lost its progress repeats the batches; their folders are overwritten.
    assert feed(spark, source, out, str(tmp_path / "fresh")) == expected(rows)


def test_votes_before_the_first_file(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    assert feed(spark, str(source), str(tmp_path / "out"), str(tmp_path / "progress")) == {}


def test_batches_are_merged_and_may_be_repeated_afterwards(spark, tmp_path):
    source, out, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    rows = [(i % 7, i, ["-1", "2.5", "3", "1e3"][i * 5 % 4]) for i in range(240)]
    for at in range(0, 240, 30):
        spark.createDataFrame(rows[at : at + 30], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", numeric_answer("a"))
    expected = {row.p: row.answer for row in majority_vote(df, "p", "n", ["i"]).collect()}
    assert feed(spark, source, out, progress, merge_every=3) == expected
    folders = finished(spark, out)
    assert "upto=" in folders[0] and len(folders) <= 4
    # All batches again, over folders that are merged already.
    assert feed(spark, source, out, str(tmp_path / "fresh"), merge_every=3) == expected
    last = int(finished(spark, out)[-1].rpartition("=")[2])
    merge_batches(spark, out, "p", "n", last)
    merge_batches(spark, out, "p", "n", last)
    assert {row.p: row.answer for row in current_votes(spark, out, "p", "n").collect()} == expected
    # A merge that broke off has no mark of a finished write and is not read.
    (tmp_path / "out" / f"upto={last + 100}").mkdir()
    assert {row.p: row.answer for row in current_votes(spark, out, "p", "n").collect()} == expected
