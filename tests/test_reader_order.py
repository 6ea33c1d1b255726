import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import mixing
from tallyloom.sources import files, reader_order, revisions
from tallyloom.sources.datasets import read_split


@pytest.fixture
def table(spark, tmp_path):
    """Seven files of different sizes, one empty, in a folder with an odd name; ids are in no order."""
    home = f"{tmp_path}/a b%c"
    for part, n in enumerate([10, 0, 1, 25, 7, 40, 3]):
        rows = spark.range(n).select((1000 - part * 100 + F.col("id")).alias("id"), F.lit("q").alias("prompt"))
        rows.coalesce(1).write.parquet(f"{home}/x{part}")
        [file] = glob.glob(glob.escape(f"{home}/x{part}") + "/part-*")
        os.link(file, f"{home}/part-{part}.parquet")
    return home


ORDER = [1000 - part * 100 + i for part, n in enumerate([10, 0, 1, 25, 7, 40, 3]) for i in range(n)]


def read(spark, home):
    return spark.read.option("pathGlobFilter", "part-?.parquet").parquet(home)


def test_places_and_prefixes_of_several_files(spark, table):
    df = read(spark, table)
    placed = reader_order.with_reader_place(df)
    assert [row.id for row in placed.orderBy("place").collect()] == ORDER
    assert sorted(row.place for row in placed.collect()) == list(range(len(ORDER)))
    for k in (-1, 0, 1, 10, 11, 12, 36, 50, 85, 86, 1000):
        assert sorted(row.id for row in reader_order.reader_prefix(df, k).collect()) == sorted(ORDER[: max(k, 0)])
    assert reader_order.reader_fraction(df, 0.29).count() == int(0.29 * len(ORDER))
    with pytest.raises(ValueError, match="between 0 and 1"):
        reader_order.reader_fraction(df, 1.1)


def test_files_behind_the_cut_are_not_opened(spark, table):
    df = read(spark, table)
    counted = reader_order.file_rows(df)
    kept = reader_order.reader_prefix(df, 30, counted)
    for part in (4, 5, 6):
        path = f"{table}/part-{part}.parquet"
        os.unlink(path)
        with open(path, "w") as out:
            out.write("no parquet")
    assert sorted(row.id for row in kept.collect()) == sorted(ORDER[:30])
    assert reader_order.with_reader_place(kept, "p", counted).agg(F.max("p")).first()[0] == 29
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()


def test_reader_order_needs_files(spark):
    with pytest.raises(ValueError, match="straight from files"):
        reader_order.file_rows(spark.range(5))


def test_mix_without_an_order_key(spark, table):
    mixed = mixing.mix({"a": 0.29, "b": 1.0}, lambda name, split, revision: read(spark, table), shuffle=False)
    keys = {(row.mix_pos, row.row_key) for row in mixed["train"].collect()}
    n = len(ORDER)
    assert keys == {(0, i) for i in range(int(0.29 * n))} | {(1, i) for i in range(n)}
    assert mixed["test"].count() == 2 * n and set(mixed["train"].columns) == {"mix_pos", "row_key", "prompt"}
    one = mixing.mix({"a": 1.0}, lambda *_: read(spark, table), splits=["train"])["train"]
    again = mixing.mix({"a": 1.0}, lambda *_: read(spark, table), splits=["train"])["train"]
    assert mixing.arrange(one).collect() == mixing.arrange(again).collect()


def ids(df):
    return sorted(row.id for row in df.collect())


def test_revisions_share_files(spark, tmp_path):
    root = str(tmp_path)
    first = spark.range(0, 10, 1, 2)
    revisions.commit_revision(spark, "org/set", "v1", {"train": first, "test": spark.range(3)}, root)
    added = spark.range(10, 15).withColumn("score", F.lit(0.5))
    revisions.commit_revision(spark, "org/set", "v2", {"train": added}, root, base="v1")
    revisions.commit_revision(spark, "org/set", "v3", {"train": spark.range(2)}, root, base="v1", keep=False)
    assert revisions.revisions(spark, "org/set", root) == ["v1", "v2", "v3"]
    assert ids(read_split(spark, "org/set", "train", "v1", root)) == list(range(10))
    assert ids(read_split(spark, "org/set", "train", "v2", root)) == list(range(15))
    assert ids(read_split(spark, "org/set", "train", "v3", root)) == [0, 1]
    later = read_split(spark, "org/set", "train", "v2", root)
    assert later.filter("score is null").count() == 10 and later.filter("score = 0.5").count() == 5
    parts = {r: revisions.manifest(spark, "org/set", r, root)["splits"] for r in ("v1", "v2", "v3")}
    assert parts["v1"]["train"]["files"] == parts["v2"]["train"]["files"][: len(parts["v1"]["train"]["files"])]
    assert parts["v1"]["test"] == parts["v2"]["test"] == parts["v3"]["test"]
    assert sum(f["rows"] for f in parts["v2"]["train"]["files"]) == 15


def test_unknown_and_repeated_revisions_raise(spark, tmp_path):
    root = str(tmp_path)
    revisions.commit_revision(spark, "set", "main", {"train": spark.range(4)}, root)
    for wrong in ({"revision": "v9"}, {"split": "test"}):
        with pytest.raises(ValueError, match="has no"):
            read_split(spark, "set", **{"split": "train", "revision": "main", **wrong}, root=root)
    with pytest.raises(ValueError, match="no revision"):
        revisions.commit_revision(spark, "set", "v2", {}, root, base="v1")
    with pytest.raises(FileExistsError):
        revisions.commit_revision(spark, "set", "main", {"train": spark.range(1)}, root)
    with pytest.raises(ValueError, match="changes its type"):
        revisions.commit_revision(spark, "set", "v2", {"train": spark.range(1).selectExpr("cast(id as string) as id")}, root, base="main")
    assert ids(read_split(spark, "set", "train", root=root)) == [0, 1, 2, 3]
    revisions.commit_revision(spark, "set", "main", {"train": spark.range(1)}, root, move=True)
    assert ids(read_split(spark, "set", "train", root=root)) == [0]


def test_a_commit_that_breaks_off_leaves_no_revision(spark, tmp_path):
    root = str(tmp_path)
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        revisions.commit_revision(spark, "set", "main", {"train": spark.range(2), "test": broken}, root)
    assert revisions.revisions(spark, "set", root) == []


def test_an_empty_split(spark, tmp_path):
    root = str(tmp_path)
    revisions.commit_revision(spark, "set", "main", {"train": spark.range(0)}, root)
    assert read_split(spark, "set", "train", root=root).dtypes == spark.range(0).dtypes
    assert read_split(spark, "set", "train", root=root).count() == 0


def test_small_files_are_whole_and_written_once(spark, tmp_path):
    path = f"{tmp_path}/x/y.json"
    files.write_text(spark, path, json.dumps({"é": 1}))
    with pytest.raises(FileExistsError):
        files.write_text(spark, path, "again")
    assert json.loads(files.read_text(spark, path)) == {"é": 1}
    files.write_text(spark, path, "new", replace=True)
    assert files.read_text(spark, path) == "new" and files.names_in(spark, f"{tmp_path}/x") == ["y.json"]
    assert files.names_in(spark, f"{tmp_path}/none") == []
