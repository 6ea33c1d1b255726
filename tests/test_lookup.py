import pytest
from pyspark.sql import functions as F

from tallyloom.operators.lookup import fits_broadcast, hot_keys, lookup


@pytest.fixture(scope="module")
def sides(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100)
    left = spark.range(6000).select("id", hot.alias("k"))
    right = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 10 + 7).alias("v"))
    return left, right.union(spark.createDataFrame([(7, 77)], "k long, v long"))


def test_size_check(spark):
    assert fits_broadcast(spark.range(10), rows=10)
    assert not fits_broadcast(spark.range(11), rows=10)
    assert not fits_broadcast(spark.createDataFrame([("x" * 50,)], "s string"), size=49)
    assert fits_broadcast(spark.range(0))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, sides, how):
    left, right = sides
    plain = left.join(right, "k", how)
    expected = sorted(map(tuple, plain.select(sorted(plain.columns)).collect()))
    for broadcast_rows, hot_rows in ((1000, 10), (5, 100), (5, 10**6)):
        joined = lookup(left, right, ["k"], ["id"], how, broadcast_rows, hot_rows)
        assert sorted(map(tuple, joined.select(sorted(plain.columns)).collect())) == expected


def test_hot_key_is_spread(spark, sides):
    left, right = sides
    joined = lookup(left, right, ["k"], ["id"], "inner", 5, 100)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "__salt" in plan
    assert joined.columns == ["k", "id", "v"]


def test_every_hot_key_is_split_however_many_there_are(spark):
    left = spark.range(60_000).select("id", (F.col("id") % 1500).alias("k"))
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    hot = hot_keys(left, ["k"], 10)
    assert hot.count() == 1500 and {row[0] for row in hot.select("__salts").distinct().collect()} == {4}
    joined = lookup(left, right, ["k"], ["id"], "inner", 5, 10)
    assert joined.count() == 60_000 and joined.filter("v <> k + 1").count() == 0
    # A key above the threshold is one in MOST_HOT of all rows, so there can be no more of them.
    assert hot_keys(left, ["k"], max(10, 60_000 // 50_000)).count() <= 50_000


@pytest.mark.parametrize("how", ["left", "left_anti", "left_semi", "inner"])
def test_rows_without_a_key_are_spread(spark, how):
    left = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 40).alias("k"))
    right = spark.range(0, 40, 4).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plain = left.join(right, "k", how)
    joined = lookup(left, right, ["k"], ["id"], how, 2, 5)
    expected = sorted(map(str, plain.select(sorted(plain.columns)).collect()))
    assert sorted(map(str, joined.select(sorted(plain.columns)).collect())) == expected
