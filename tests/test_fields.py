from tallyloom.functions.templates import MESSAGES_TYPE
from tallyloom.operators import fields


def test_validation_split_is_stable(spark):
    rows = spark.range(4000)
    first = fields.with_validation_split(rows, "id").filter("split = 'validation'")
    again = fields.with_validation_split(rows.repartition(9), "id").filter("split = 'validation'")
    chosen = {row.id for row in first.collect()}
    assert chosen == {row.id for row in again.collect()}
    assert 140 < len(chosen) < 260


def test_lengths_prefix_and_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "x y"), (2, "a", "z " * 200)], "id int, q string, r string")
    assert [row.id for row in fields.shorter_than(rows, "q", 3).collect()] == [2]
    pairs = fields.pair_columns(rows, "q", "r", "Q: ", 3, 128).orderBy("id").collect()
    assert [row.prompt for row in pairs] == ["Q: a b", "Q: a"]
    assert len(pairs[1].completion.split()) == 128
    whole = fields.pair_columns(rows, "q", "r", "Q: ").orderBy("id").collect()
    assert [row.completion for row in whole] == ["x y", "z " * 200]
    assert [row.id for row in fields.prediction_rows(rows, ["id"], 1).collect()] == [1]
    assert fields.prediction_rows(rows, ["id"], None).count() == 2


def test_cutting_keeps_white_space(spark):
    texts = ["def f():\n    return 1\n", "  a\tb\n c  d ", "", "   ", None, "one"]
    rows = spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "id int, q string, r string")
    for n, expected in ((3, ["def f():\n    return", "  a\tb\n c", "", "   ", None, "one"]), (4, texts), (1, ["def", "  a", "", "   ", None, "one"])):
        cut = fields.pair_columns(rows, "q", "r", max_target=n).orderBy("id").collect()
        assert [row.completion for row in cut] == expected


def test_user_turn_mask(spark):
    rows = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], f"m {MESSAGES_TYPE}")
    masked = rows.select(fields.mask_user_turns("m").alias("m")).first().m
    assert [(m.role, m.masked) for m in masked] == [("user", True), ("assistant", False)]
