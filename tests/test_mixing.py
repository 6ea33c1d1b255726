import pytest
from pyspark.sql import functions as F

from tallyloom.functions.templates import MESSAGES_TYPE, PROBLEM_SOLUTION
from tallyloom.operators.metrics import evaluation_metrics, rows_per_split
from tallyloom.plans import mixing
from tallyloom.plans.calibration import calibration_sample
from tallyloom.sources import datasets, problems


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("sets"))
    for name, revision, rows in (("one", "main", 100), ("org/two", "v2", 7), ("org/two", "main", 3)):
        for split in ("train", "test"):
            first, last = (0, rows) if split == "train" else (rows, rows + 5)
            spark.range(first, last).select(
                "id",
                F.expr(f"cast(array(struct('user' as role, cast(id as string) as content)) as {MESSAGES_TYPE})").alias(
                    "messages"
                ),
                F.lit("unused").alias("notes"),
                *([F.lit(0.5).alias("score")] if name == "one" else []),
            ).write.parquet(datasets.dataset_path(name, split, revision, home))
    return home


def reader(spark, root):
    return lambda name, split, revision: datasets.read_split(spark, name, split, revision, root)


def test_paths_and_splits():
    assert datasets.dataset_path("a/b", "train", root="r") == "r/a/b/main/train"
    assert datasets.dataset_path("my/data/set", "test", "v1", "r") == "my/data/set/test"
    assert [datasets.split_kind(s) for s in ("train", "test_sft", "train_test")] == ["train", "test", "train"]
    with pytest.raises(ValueError, match="named after"):
        datasets.split_kind("valid")


def test_mix_cuts_training_sets_only(spark, root):
    spec = {"one": 0.29, "org/two": {"fraction": 0.5, "revision": "v2"}}
    mixed = mixing.mix(spec, reader(spark, root), "id")
    train = [(row.mix_pos, row.row_key) for row in mixing.arrange(mixed["train"].drop("digest")).collect()]
    assert train == [(0, i) for i in range(28)] + [(1, i) for i in range(3)]
    assert mixed["test"].count() == 10
    assert set(mixed["train"].columns) == {"mix_pos", "row_key", "messages", "score", "digest"}
    counts = {row.split: row.n_rows for row in rows_per_split(mixing.as_one(mixed)).collect()}
    assert counts == {"train": 31, "test": 10}


def test_a_zero_fraction_and_default_values(spark, root):
    mixed = mixing.mix({"one": 0, "org/two": {}}, reader(spark, root), "id", ["train"], shuffle=False)
    assert sorted(row.mix_pos for row in mixed["train"].collect()) == [1, 1, 1]
    assert "test" not in mixed


def test_every_train_split_of_a_dataset_is_cut(spark, root):
    def read(name, split, revision):
        return datasets.read_split(spark, name, "train", revision, root)

    mixed = mixing.mix({"one": 0.1, "org/two": 1.0}, read, "id", ["train_a", "train_b"])
    counts = {row.mix_pos: row["count"] for row in mixed["train"].groupBy("mix_pos").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 3, 3: 3}


def test_errors_come_before_any_read():
    def read(*_):
        raise AssertionError("read")

    for spec, message in (({"x": -0.1}, "below zero"), ({"x": 1.5}, "above 1"), ({}, "no dataset")):
        with pytest.raises(ValueError, match=message):
            mixing.mix(spec, read, "id")
    with pytest.raises(ValueError, match="named after"):
        mixing.mix({"x": 1.0}, read, "id", ["valid"])


def test_shuffle_is_a_permutation_and_repeatable(spark, root):
    spec = {"one": 1.0, "org/two": 1.0}
    runs = [
        [(r.mix_pos, r.row_key) for r in mixing.arrange(mixing.mix(spec, reader(spark, root), "id", ["train"])["train"]).collect()]
        for _ in range(2)
    ]
    plain = mixing.arrange(mixing.mix(spec, reader(spark, root), "id", ["train"], shuffle=False)["train"])
    assert runs[0] == runs[1] != sorted(runs[0])
    assert sorted(runs[0]) == [(r.mix_pos, r.row_key) for r in plain.collect()]


def test_only_needed_columns_are_read_and_cutoffs_reach_the_scan(spark, root):
    mixed = mixing.mix({"one": 0.29, "org/two": 1.0}, reader(spark, root), "id", ["train"], shuffle=False)
    plan = mixed["train"]._jdf.queryExecution().executedPlan().toString()
    assert "notes" not in plan
    assert "LessThanOrEqual(id,27)" in plan
    assert "Exchange" not in plan


def test_tagged_table_gives_the_same_mix(spark, root):
    spec = {"one": 0.29, "org/two": 0.5}
    separate = mixing.mix(spec, reader(spark, root), "id")
    tables = [
        datasets.read_split(spark, name, split, "main", root).drop("notes").withColumns({"set": F.lit(name), "part": F.lit(split)})
        for name in spec
        for split in ("train", "test")
    ]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    tagged = mixing.mix_tagged(union, spec, "set", "part", "id")
    for kind in ("train", "test"):
        columns = ["digest", "mix_pos", "row_key", "messages"]
        assert mixing.arrange(separate[kind]).select(columns).collect() == mixing.arrange(tagged[kind]).select(columns).collect()


def test_tagged_mix_reads_one_scan_and_pushes_its_cutoffs(spark, tmp_path):
    rows = spark.range(400).select("id", F.concat(F.lit("s"), F.col("id") % 4).alias("set"), F.lit("q").alias("prompt"))
    rows.withColumn("part", F.when(F.col("id") < 300, "train").otherwise("test")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    mixed = mixing.mix_tagged_rows(table, {"s0": 0.5, "s2": 1.0}, "set", "part", "id")
    counts = {(r.kind, r.mix_pos): r["count"] for r in mixed.groupBy("kind", "mix_pos").count().collect()}
    assert counts == {("train", 0): 37, ("train", 1): 75, ("test", 0): 25, ("test", 1): 25}
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "LessThanOrEqual(id,144)" in plan and "EqualTo(set,s0)" in plan
    with pytest.raises(ValueError, match="no rows of s9"):
        mixing.mix_tagged_rows(table, {"s0": 0.5, "s9": 1.0}, "set", "part", "id")


def test_render_mix(spark, root):
    mixed = mixing.mix({"org/two": 1.0}, reader(spark, root), "id", shuffle=False)
    rendered = mixing.render_mix(mixed, PROBLEM_SOLUTION)
    assert sorted(row.text for row in rendered["train"].collect()) == [f"### Problem: {i}\n" for i in range(3)]


def test_calibration_sample_size(spark):
    rows = spark.range(1000).select(
        "id",
        F.lit("p").alias("problem"),
        F.expr(f"cast(array(struct('user','p'), struct('assistant','s t')) as {MESSAGES_TYPE})").alias("messages"),
    )
    drawn = calibration_sample(rows, "id").collect()
    assert len({row.id for row in drawn}) == 256
    assert {(row.text, row.n_tokens) for row in drawn} == {("### Problem: p\n### Solution: s t\n", 7)}


def test_metrics_and_sinks(spark, tmp_path):
    losses = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5000.0)], "t string, loss double")
    result = evaluation_metrics(losses, "t", "loss", 1)
    datasets.write_metrics(result, str(tmp_path / "m"))
    found = {row.t: row for row in spark.read.schema(result.schema).json(str(tmp_path / "m")).collect()}
    assert (found["a"].eval_samples, found["a"].eval_loss) == (1, 2.0)
    assert abs(found["a"].perplexity - 7.38905609893065) < 1e-9
    assert {row.t: row.perplexity for row in result.collect()}["b"] == float("inf")


def test_problem_feed_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p1", "1005"), (2, "p2", "-1")], "id long, problem string, answer string")
    hidden = problems.validation_problems(rows)
    assert [(r.ground_truth, r.answer) for r in hidden.orderBy("id").collect()] == [(5, -1), (999, -1)]
    feed = problems.problem_feed(hidden, seed=1)
    assert feed.columns == ["id", "problem", "text", "digest"]
    problems.write_predictions(spark.createDataFrame([(1, 5)], "id long, answer int"), str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(1, 5)]
