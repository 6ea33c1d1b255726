import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import tokens
from tallyloom.operators import packing
from tallyloom.plans.calibration import calibration_sample



def make_lengths():
    return lambda texts: [[len(word) for word in text.split()] for text in texts]


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_masks_of_blocks(spark, block):
    dice = random.Random(block)
    turns = [(c, t, dice.choice(["user", "assistant", "system"]), " ".join("w" * dice.randrange(1, 4) for _ in range(dice.choice([0, 1, 3, 40])))) for c in range(20) for t in range(5)]
    rows = spark.createDataFrame(turns, "c long, t long, role string, text string").repartition(4)
    rows = rows.select(F.struct("c", "t").alias("at"), (F.col("role") != "user").alias("learnt"), "text")
    sequences = packing.encode_sequences(rows, "at", "text", carry=["learnt"])
    placed = packing.place_sequences(sequences, "at", "n_tokens", ["learnt"])
    filled = {row.block_id: row.tokens for row in packing.fill_blocks(placed, sequences, "at", "tokens", block).collect()}
    labels = packing.label_spans(placed, "at", "learnt", block)
    masks = {row.block_id: row for row in labels.withColumn("mask", packing.label_mask("n_tokens", "spans")).collect()}
    line = [(word, role != "user") for _, _, role, text in sorted(turns) for word in text.split()]
    expected = {i: line[i * block : (i + 1) * block] for i in range(-(-len(line) // block))}
    assert filled.keys() == masks.keys() == expected.keys()
    for i, own in expected.items():
        assert filled[i] == [word for word, _ in own] and masks[i].mask == [learnt for _, learnt in own]
        assert len(masks[i].mask) == len(filled[i]) == masks[i].n_tokens <= block


def test_a_users_tokenizer_everywhere(spark):
    texts = ["one three", None, "", "four five sixes", " a "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    ids = [[3, 5], None, [], [4, 4, 5], [1]]
    found = rows.select("i", tokens.encoded("t", make_lengths).alias("ids"), tokens.token_count("t", make_lengths).alias("n")).orderBy("i").collect()
    assert [row.ids for row in found] == ids and [row.n for row in found] == [len(x or ()) for x in ids]
    cut = rows.select("i", tokens.truncated_tokens("t", 2, "left", make_lengths).alias("c"), tokens.truncated_tokens("t", 2, make=make_lengths).alias("d"))
    assert [(row.c, row.d) for row in cut.orderBy("i").collect()][3] == ([4, 5], [4, 4])
    blocks = packing.pack_texts(rows, "i", "t", 4, make_lengths).orderBy("block_id").collect()
    assert [row.tokens for row in blocks] == [[3, 5, 4, 4], [5, 1]]
    plain = packing.pack_texts(rows, "i", "t", 4).orderBy("block_id").collect()
    assert [row.tokens for row in plain] == [["one", "three", "four", "five"], ["sixes", "a"]]


def test_texts_are_encoded_once(spark, tmp_path):
    log = str(tmp_path / "asked")

    def make():
        def note(texts):
            with open(log, "a") as out:
                out.writelines(f"{text}\n" for text in texts)
            return [[1] * len(text) for text in texts]

        return note

    rows = spark.range(50).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    assert packing.pack_texts(rows, "id", "t", 16, make).selectExpr("sum(size(tokens))").first()[0] == 10 * 2 + 40 * 3
    assert sorted(open(log).read().split()) == sorted(f"t{i}" for i in range(50))


def test_calibration_counts_by_a_users_tokenizer(spark):
    turn = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([(1, "a b", [("user", "a b"), ("assistant", "c")])], f"id long, problem string, messages {turn}")
    row = calibration_sample(rows, "id", make=lambda: lambda texts: [[7] * 5 for _ in texts]).first()
    assert row.n_tokens == 5


def test_a_tokenizer_that_loses_texts_raises(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="lists of ids"):
        rows.select(tokens.encoded("t", lambda: lambda texts: [])).collect()
