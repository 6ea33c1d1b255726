import json
import os

import pytest

from tallyloom.sources import files
from tallyloom.sources.answer_log import AnswerLog


@pytest.fixture
def feed(spark):
    return spark.createDataFrame([(10 + i, i, f"p{i}") for i in range(25)], "id long, place long, problem string").repartition(4)


def test_a_crash_between_two_problems_leaves_whole_answers(spark, feed, tmp_path):
    path, asked = str(tmp_path / "log"), []

    def answer(row):
        asked.append(row.id)
        if len(asked) in (4, 9):
            raise KeyboardInterrupt
        return row.id * 2

    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            AnswerLog(spark, path, feed).solve(answer)
    log = AnswerLog(spark, path, feed)
    assert log.solve(answer) == 25 - 3 - 4
    # Only the problems whose answer was lost are asked again.
    assert asked == [*range(10, 14), *range(13, 18), *range(17, 35)]
    rows = log.answers().collect()
    assert sorted(map(tuple, rows)) == [(i, 10 + i, (10 + i) * 2) for i in range(25)]
    assert log.solve(answer) == 0 and len(os.listdir(path)) - len([n for n in os.listdir(path) if n.startswith(".")]) == 25


def test_the_next_problem_waits_for_its_answer(spark, feed, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"), feed)
    with pytest.raises(RuntimeError, match="no problem"):
        log.predict(1)
    left = log.problems_left(chunk=2)
    assert next(left).id == 10
    with pytest.raises(RuntimeError, match="no answer yet"):
        next(left)
    left = log.problems_left(chunk=2)
    for place in range(5):
        assert next(left).place == place
        log.predict(place)
        with pytest.raises(RuntimeError, match="no problem"):
            log.predict(place)
    assert [row.answer for row in log.answers().orderBy("place").collect()] == list(range(5))


def test_an_answer_of_another_run_stays(spark, feed, tmp_path):
    """Two runs have the same problem out: the second answer raises, the first one stays."""
    path = str(tmp_path / "log")
    one, two = AnswerLog(spark, path, feed), AnswerLog(spark, path, feed)
    assert next(one.problems_left()).id == next(two.problems_left()).id == 10
    one.predict(1)
    with pytest.raises(FileExistsError):
        two.predict(2)
    assert [row.answer for row in one.answers().collect()] == [1]
    entry = [name for name in os.listdir(path) if not name.startswith(".")]
    assert json.loads((tmp_path / "log" / entry[0]).read_text()) == {"place": 0, "id": 10, "answer": 1}


def test_an_empty_log(spark, feed, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"), feed.filter("false"))
    assert log.solve(lambda row: 1) == 0 and log.answers().collect() == []


def test_the_work_for_an_answer_does_not_grow_with_the_log(spark, feed, tmp_path, monkeypatch):
    """The store is looked up and the folder listed once per run, not for every answer or chunk."""
    looked, place = [], files._place
    monkeypatch.setattr(files, "_place", lambda *args: looked.append(args) or place(*args))
    log = AnswerLog(spark, str(tmp_path / "log"), feed)
    listed, places = [], log.places
    monkeypatch.setattr(log, "places", lambda: listed.append(1) or places())
    for _ in log.problems_left(chunk=2):
        log.predict(1)
    assert len(looked) == len(listed) == 1 and len(places()) == 25


def test_an_answer_given_meanwhile_is_passed_over(spark, feed, tmp_path):
    path = str(tmp_path / "log")
    one, two = AnswerLog(spark, path, feed), AnswerLog(spark, path, feed)
    left = one.problems_left()
    assert next(left).id == 10
    one.predict(1)
    assert two.solve(lambda row: 2, 3) == 3
    assert next(left).id == 14


class Counted:
    """Stands for a store and counts the calls it gets."""

    def __init__(self, store):
        self.store, self.calls = store, []

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.store, name)


def test_an_answer_takes_no_call_to_a_local_store(spark, feed, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"), feed)
    store = log._folder._system = Counted(log._folder._system)
    assert log.solve(lambda row: 1, 5) == 5
    first = len(store.calls)
    assert log.solve(lambda row: 1) == 20 and len(store.calls) == first


def test_the_feed_is_read_a_fixed_number_of_times(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(place):
        read.add(1)
        return 10 + place, place

    feed = spark.createDataFrame(spark.sparkContext.parallelize(range(25), 4).map(counted), "id long, place long")
    log, places = AnswerLog(spark, str(tmp_path / "log"), feed), []
    for row in log.problems_left(chunk=2):
        places.append(row.place)
        log.predict(1)
    # Counted, sampled and put in order.
    assert places == list(range(25)) and read.value <= 3 * 25


def test_a_task_reads_many_answers(spark, feed, tmp_path):
    log = AnswerLog(spark, str(tmp_path / "log"), feed)
    log.solve(lambda row: row.id)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        answers = log.answers()
        assert answers.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, answers.collect())) == [(i, 10 + i, 10 + i) for i in range(25)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_places_in_any_order_and_with_gaps(spark, tmp_path):
    rows = [(i, place) for i, place in enumerate([7, 0, 300, 5, None, 2])]
    log = AnswerLog(spark, str(tmp_path / "log"), spark.createDataFrame(rows, "id long, place long"))
    assert log.solve(lambda row: row.place) == 5
    assert sorted(map(tuple, log.answers().collect())) == [(0, 1, 0), (2, 5, 2), (5, 3, 5), (7, 0, 7), (300, 2, 300)]


@pytest.mark.parametrize("local", [True, False])
def test_a_folder_keeps_its_rules_here_and_through_the_store(spark, tmp_path, local):
    path = tmp_path / "an é, b"
    folder = files.Folder(spark, str(path))
    if not local:
        folder._local = ""
    assert folder.names() == [] and not folder.holds("a, b.json")
    for name in ("c.json", "a, b.json", "é.json"):
        folder.write(name, f"{name}\n" * 200)
    assert folder.holds("a, b.json") and not folder.holds("b.json")
    with pytest.raises(FileExistsError, match="there already"):
        folder.write("c.json", "again")
    assert folder.names() == ["a, b.json", "c.json", "é.json"]
    # Nothing is left over, and checksums are beside the files.
    assert sorted(os.listdir(path)) == sorted(f for name in folder.names() for f in (name, f".{name}.crc"))
    assert [row.value for row in spark.read.text(str(path / "c.json")).distinct().collect()] == ["c.json"]
    folder.write("c.json", "new", replace=True)
    assert files.read_text(spark, str(path / "c.json")) == "new"
    (path / "a, b.json").write_text("damaged")
    with pytest.raises(Exception, match="(?i)checksum"):
        spark.read.text(str(path / "a, b.json")).collect()


def test_a_file_system_without_links(spark, tmp_path, monkeypatch):
    def refuse(*args):
        raise PermissionError

    monkeypatch.setattr(os, "link", refuse)
    folder = files.Folder(spark, str(tmp_path / "x"))
    folder.write("a", "1")
    with pytest.raises(FileExistsError):
        folder.write("a", "2")
    assert files.read_text(spark, str(tmp_path / "x" / "a")) == "1" and sorted(os.listdir(tmp_path / "x")) == [".a.crc", "a"]


def test_a_write_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = files.Folder(spark, str(tmp_path / "x"))
    folder.write("a", "1")

    def full(*args):
        raise OSError(28, "no space left")

    for step in ("link", "rename"):
        monkeypatch.setattr(os, step, full)
    with pytest.raises(OSError, match="no space"):
        folder.write("b", "2")
    assert folder.names() == ["a"] and sorted(os.listdir(tmp_path / "x")) == [".a.crc", "a"]
