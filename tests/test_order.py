import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.digests import seeded_digest
from tallyloom.operators import order


def skewed(spark, seed=1):
    """Three groups with keys in no order; the first holds over half of the rows."""
    dice = random.Random(seed)
    rows = [(g, k, f"k{k:06d}") for g, n in (("a", 6000), ("b", 3000), ("c", 7)) for k in dice.sample(range(10**6), n)]
    dice.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, s string").repartition(6)


@pytest.mark.parametrize("key", [["k"], ["s"], ["half", "k"]])
@pytest.mark.parametrize("exact_rows", [50, 100_000])
def test_prefixes_are_exact_with_and_without_sampling(spark, key, exact_rows):
    rows, df = skewed(spark)
    df = df.withColumn("half", F.floor(F.col("k") / 250_000))
    fractions = {"a": 0.29, "b": 0.999, "c": 0.5}
    kept = order.keep_prefixes(df, "g", key, fractions, exact_rows=exact_rows, sample_rows=300)
    found = {(row.g, row.k) for row in kept.collect()}
    expected = set()
    for g, fraction in fractions.items():
        keys = sorted(k for group, k, _ in rows if group == g)
        expected |= {(g, k) for k in keys[: int(fraction * len(keys))]}
    assert found == expected


def test_prefix_rounds_down_and_handles_the_ends(spark):
    df = spark.range(100).withColumn("g", F.lit(0))
    for fraction, rows in ((0.29, 28), (0.0, 0), (1.0, 100), (0.005, 0)):
        assert order.keep_prefixes(df, "g", ["id"], {0: fraction}).count() == rows
    assert order.keep_prefixes(df, "g", ["id"], {1: 1.0}).count() == 0


def test_ties_and_nulls_are_reported(spark):
    ties = spark.createDataFrame([(0, 1), (0, 1), (0, 1), (0, 2)], "g int, k int")
    with pytest.raises(ValueError, match="not unique"):
        order.keep_prefixes(ties, "g", ["k"], {0: 0.5})
    same = spark.range(1000).select(F.lit(0).alias("g"), F.lit(3).alias("k"))
    with pytest.raises(ValueError, match="apart"):
        order.keep_prefixes(same, "g", ["k"], {0: 0.5}, exact_rows=10, sample_rows=50)
    nulls = spark.createDataFrame([(0, 1), (0, None)], "g int, k int")
    with pytest.raises(ValueError, match="null"):
        order.keep_prefixes(nulls, "g", ["k"], {0: 0.5})


@pytest.mark.parametrize("k", [0, 1, 10, 999, 1000, 5000])
def test_first_rows(spark, k, monkeypatch):
    monkeypatch.setattr(order, "SMALL_LIMIT", 20)
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    found = sorted(row.x for row in order.first_rows(df, ["x"], k).collect())
    expected = sorted(i * 7919 % 1009 for i in range(1000))[:k]
    assert found == expected


@pytest.mark.parametrize("k", [0, 3, 19, 20, 21, 29])
def test_prefixes_refuse_nulls_and_ties_on_both_sides_of_the_switch(spark, k, monkeypatch):
    monkeypatch.setattr(order, "SMALL_LIMIT", 20)
    nulls = spark.range(30).select(F.when(F.col("id") > 2, F.col("id")).alias("x"))
    for take in (lambda df: order.first_rows(df, ["x"], k), lambda df: order.first_by_digest(df, seeded_digest(1, "x"), ["x"], k)):
        with pytest.raises(ValueError, match="null"):
            take(nulls)
    threes = spark.range(60).select((F.col("id") / 3).cast("long").alias("x"))
    if k % 3:
        with pytest.raises(ValueError, match="apart|not unique"):
            order.first_rows(threes, ["x"], k)
    else:
        assert order.first_rows(threes, ["x"], k).count() == k
    same = spark.range(60).select(F.lit(1).alias("x"))
    if k:
        with pytest.raises(ValueError, match="apart|not unique"):
            order.first_by_digest(same, seeded_digest(1, "x"), ["x"], k)
    assert order.first_by_digest(same, seeded_digest(1, "x"), ["x"], 60).count() == 60


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("exact_rows", [10, 100_000])
def test_digest_sample(spark, exact_rows, monkeypatch):
    monkeypatch.setattr(order, "EXACT_ROWS", exact_rows)
    df = spark.range(3000)
    drawn = order.first_by_digest(df, seeded_digest(5, "id"), ["id"], 40)
    expected = sorted(range(3000), key=lambda i: digest(5, i))[:40]
    assert sorted(row.id for row in drawn.collect()) == sorted(expected)


def test_digest_sample_falls_back_when_too_little_is_near(spark, monkeypatch):
    monkeypatch.setattr(order, "EXACT_ROWS", 10)
    df = spark.range(5000)
    far = F.concat(F.lit("f"), seeded_digest(1, "id"))
    expected = sorted(range(5000), key=lambda i: digest(1, i))[:5]
    found = order.first_by_digest(df, far, ["id"], 5)
    assert sorted(row.id for row in found.collect()) == sorted(expected)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_digest_rank_is_a_permutation_whatever_the_partitions(spark, partitions):
    df = spark.range(2000).repartition(partitions).withColumn("d", seeded_digest(42, "id"))
    ranked = order.with_digest_rank(df, "d", ["id"], "place").orderBy("place").collect()
    assert [row.place for row in ranked] == list(range(1, 2001))
    assert [row.id for row in ranked] == sorted(range(2000), key=lambda i: digest(42, i))


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_total(spark, partitions):
    df = spark.range(500).select((F.col("id") * 37 % 503).alias("k"), (F.col("id") % 5).alias("w"))
    found = order.with_running_total(df.repartition(partitions), ["k"], "w", "t").orderBy("k").collect()
    at = 0
    for row in found:
        assert row.t == at
        at += row.w
    assert {row.t_all for row in found} == {at}


def test_group_place_with_one_group_over_many_partitions(spark):
    rows, df = skewed(spark, 3)
    found = {(row.g, row.k): row.place for row in order.with_group_place(df, ["g"], ["k"], "place").collect()}
    expected = {}
    for g in "abc":
        expected |= {(g, k): i for i, k in enumerate(sorted(k for group, k, _ in rows if group == g))}
    assert found == expected


def test_group_place_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (5, 3)], "g int, k int")
    found = order.with_group_place(df, ["g"], ["k"], "place").collect()
    assert {(row.g, row.k): row.place for row in found} == {(None, 1): 0, (None, 2): 1, (5, 3): 0}


def test_digest_ranks_refuse_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, "aa"), (1, "aa"), (2, "bb")], "k int, d string")
    with pytest.raises(Exception, match="do not tell rows apart"):
        order.with_digest_rank(rows, "d", ["k"], "place").collect()
    lost = spark.createDataFrame([(1, "aa"), (None, "ab")], "k int, d string")
    with pytest.raises(Exception, match="hold nulls"):
        order.with_digest_rank(lost, "d", ["k"], "place").collect()
    fine = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "a0")], "k int, d string")
    assert sorted((r.k, r.place) for r in order.with_digest_rank(fine, "d", ["k"], "place").collect()) == [(1, 2), (2, 3), (3, 1)]
