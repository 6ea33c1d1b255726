import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import tokens
from tallyloom.operators.packing import fill_blocks, pack_blocks, place_sequences
from tests.conftest import values

TEXTS = ["", "  \n ", "one", " a  b\tc\n", "x\x0by\x0cz"]


def test_tokens_and_counts(spark):
    expected = [text.split() for text in TEXTS]
    assert values(spark, tokens.tokens, TEXTS) == expected
    assert values(spark, tokens.token_count, TEXTS) == [len(words) for words in expected]


@pytest.mark.parametrize("side, keep", [("right", slice(0, 2)), ("left", slice(-2, None))])
def test_truncation(spark, side, keep):
    expected = [text.split()[keep] for text in TEXTS]
    assert values(spark, lambda x: tokens.truncated_tokens(x, 2, side), TEXTS) == expected
    assert values(spark, lambda x: tokens.truncate_tokens(tokens.tokens(x), 2, side), TEXTS) == expected


def test_truncation_arguments():
    with pytest.raises(ValueError, match="side"):
        tokens.truncate_tokens("x", 2, "middle")
    assert [tokens.effective_max_length(n) for n in (1024, 100_000, 100_001)] == [1024, 100_000, 2048]


@pytest.mark.parametrize("block_size", [1, 7, 64])
def test_packing_covers_every_token_once_in_order(spark, block_size):
    dice = random.Random(block_size)
    # One row holds about a third of all tokens, some hold none.
    sizes = [dice.choice([0, 1, 3, 20]) for _ in range(300)] + [1500]
    words = {i * 3: [f"{i}.{j}" for j in range(n)] for i, n in enumerate(sizes)}
    rows = spark.createDataFrame(list(words.items()), "doc long, tokens array<string>").repartition(5)
    counts = rows.select("doc", F.size("tokens").alias("n"))
    blocks = pack_blocks(counts, "doc", "n", block_size)
    stream = [word for doc in sorted(words) for word in words[doc]]
    filled = {row.block_id: row.tokens for row in fill_blocks(place_sequences(counts, "doc", "n"), rows, "doc", "tokens", block_size).collect()}
    expected = [stream[i : i + block_size] for i in range(0, len(stream), block_size)]
    assert [filled[b] for b in sorted(filled)] == expected
    partial = {row.block_id for row in blocks.filter("is_partial").collect()}
    assert partial == ({len(expected) - 1} if len(stream) % block_size else set())


def test_packing_needs_a_positive_size(spark):
    with pytest.raises(ValueError, match="positive"):
        pack_blocks(spark.range(1).withColumn("n", F.lit(1)), "id", "n", 0)
