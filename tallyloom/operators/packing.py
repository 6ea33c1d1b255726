"""Packing token sequences into blocks of one size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..functions.tokens import MakeTokenizer, encoded
from ..session import settle
from .order import with_running_total


def place_sequences(counts: DataFrame, key: str, n_tokens: str, carry: Sequence[str] = ()) -> DataFrame:
    """Where the tokens of every row lie in the stream of all rows in ``key`` order.

    Columns: the key, ``n_tokens``, ``first_token``, ``all_tokens`` and the
    narrow ones of ``carry``. One narrow row per row; rows without tokens are
    left out.
    """
    # Stored first, so that no text is tokenised again to find sort borders.
    narrow = settle(counts.select(key, F.col(n_tokens).cast("bigint").alias("n_tokens"), *carry))
    placed = with_running_total(narrow, [key], "n_tokens", "first_token").filter("n_tokens > 0")
    return placed.select(key, "n_tokens", "first_token", F.col("first_token_all").alias("all_tokens"), *carry)


def _shares(block_size: int) -> Column:
    """The blocks a placed row takes part in: block_id, start (offset inside the row), len."""
    first, n = F.col("first_token"), F.col("n_tokens")
    blocks = F.expr(f"sequence(first_token div {block_size}, (first_token + n_tokens - 1) div {block_size})")

    def share(block: Column) -> Column:
        start = F.greatest(block * block_size - first, F.lit(0))
        end = F.least((block + 1) * block_size - first, n)
        return F.struct(block.alias("block_id"), start.alias("start"), (end - start).alias("len"))

    return F.transform(blocks, share)


def pack_blocks(counts: DataFrame, key: str, n_tokens: str, block_size: int) -> DataFrame:
    """Which tokens of which row fill which block.

    Rows follow each other in ``key`` order and the stream of their tokens is
    cut every ``block_size`` tokens; a row that crosses a border appears in
    several blocks. Columns: ``block_id``, the key, ``start`` (offset inside
    the row, from 0), ``len``, ``is_partial`` (the last block is not full).
    """
    if block_size < 1:
        raise ValueError("block_size must be positive")
    placed = place_sequences(counts, key, n_tokens)
    shares = placed.select(key, "all_tokens", F.explode(_shares(block_size)).alias("s"))
    partial = (F.col("s.block_id") + 1) * block_size > F.col("all_tokens")
    return shares.select("s.block_id", key, "s.start", "s.len", partial.alias("is_partial"))


def label_spans(placed: DataFrame, key: str, learnt: str, block_size: int) -> DataFrame:
    """Which tokens of every block count towards the loss: ``block_id``, ``n_tokens``, ``spans`` (start, len), in order.

    ``placed`` comes from ``place_sequences`` and carries ``learnt``, a flag per
    row such as a turn. Spans of neighbouring rows stay apart. No token is
    read: a block's spans follow from the narrow rows that reach into it.
    """
    shares = placed.select(key, "first_token", learnt, F.explode(_shares(block_size)).alias("s"))
    begin = (F.col("first_token") + F.col("s.start") - F.col("s.block_id") * block_size).cast("int")
    span = F.struct(begin.alias("start"), F.col("s.len").cast("int").alias("len"))
    kept = F.collect_list(F.when(F.col(learnt), span))
    return shares.groupBy("s.block_id").agg(F.sum("s.len").cast("int").alias("n_tokens"), F.array_sort(kept).alias("spans"))


def label_mask(n_tokens: Column | str, spans: Column | str) -> Column:
    """A flag per token of a block, true inside the spans; as long as the block."""
    n_tokens, spans = as_column(n_tokens), as_column(spans)
    none = F.array().cast("array<boolean>")

    def flags(value: bool, size: Column) -> Column:
        return F.array_repeat(F.lit(value), size.cast("int"))

    # What lies between two spans, and behind the last one, is not learnt.
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["start"] + s["len"]))
    gaps = F.zip_with(spans, F.slice(ends, 1, F.array_size(spans)), lambda s, end: F.struct((s["start"] - end).alias("gap"), s["len"].alias("len")))
    inside = F.flatten(F.transform(gaps, lambda g: F.concat(flags(False, g["gap"]), flags(True, g["len"]))))
    return F.concat(F.coalesce(inside, none), flags(False, n_tokens - F.element_at(ends, -1)))


def fill_blocks(placed: DataFrame, sequences: DataFrame, key: str, token_array: str, block_size: int) -> DataFrame:
    """The tokens of every block, in order: ``block_id`` and the token array.

    ``placed`` comes from ``place_sequences``. A token array meets its one
    narrow row and is cut into the shares of its blocks where it is; only the
    shares move on. A block holds at most ``block_size`` tokens, so no group
    can grow.
    """
    joined = sequences.select(key, token_array).join(placed, key)

    def piece(share: Column) -> Column:
        tokens = F.slice(F.col(token_array), share["start"].cast("int") + 1, share["len"].cast("int"))
        return F.struct(share["block_id"].alias("block_id"), tokens.alias("piece"))

    pieces = joined.select(key, F.explode(F.transform(_shares(block_size), piece)).alias("s"))
    part = F.struct(F.col(key), F.col("s.piece").alias("piece"))
    return pieces.groupBy("s.block_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["piece"])).alias(token_array)
    )


def encode_sequences(df: DataFrame, key: str, text: str, make: MakeTokenizer | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """The tokens of every row, encoded once and stored: the key, ``tokens``, ``n_tokens`` and ``carry``.

    Counting, cutting and packing all read the stored tokens, so a text passes
    the tokenizer once.
    """
    rows = settle(df.select(key, encoded(text, make).alias("tokens"), *carry))
    return rows.withColumn("n_tokens", F.coalesce(F.array_size("tokens"), F.lit(0)))


def pack_texts(df: DataFrame, key: str, text: str, block_size: int, make: MakeTokenizer | None = None) -> DataFrame:
    """Blocks of ``block_size`` tokens over all texts in ``key`` order: ``block_id`` and ``tokens``."""
    sequences = encode_sequences(df, key, text, make)
    return fill_blocks(place_sequences(sequences, key, "n_tokens"), sequences, key, "tokens", block_size)
