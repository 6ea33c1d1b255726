"""Many-to-one joins that survive keys holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it was counted to be within both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows is split into salts of about this size.
HOT_ROWS = 2_000_000
# No more keys than this can hold so large a share of the rows that they are split.
MOST_HOT = 50_000
# Salts that spread rows without a key, which find no partner anyway.
NULL_SALTS = 65_536


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Count rows and bytes, reading no more than one row over the limit."""
    text = F.concat_ws("", *[F.col(name).cast("string") for name in df.columns])
    counted = df.select(F.octet_length(text).alias("b")).limit(rows + 1)
    found, octets = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return found <= rows and octets <= size


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``left`` with ``right``, which holds at most one row per key.

    A small right side is broadcast. Otherwise keys with many left rows are
    counted and salted: their left rows are spread by a hash of the ``spread``
    columns and the one right row is repeated once per salt. Rows without a key
    are spread in the same way. A key is split if it has more than ``hot_rows``
    rows and more than one in ``MOST_HOT`` of all: so every key above that is
    split, and the broadcast table of salts holds fewer than ``MOST_HOT`` keys.
    """
    on = list(on)
    if fits_broadcast(right, broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    salts = F.broadcast(hot_keys(left, on, max(hot_rows, left.count() // MOST_HOT)))
    width = F.coalesce("__salts", F.lit(1))
    absent = reduce(or_, [F.col(name).isNull() for name in on])
    drawn = F.pmod(F.xxhash64(*spread), F.when(absent, F.lit(NULL_SALTS)).otherwise(width)).cast("int")
    salted = left.join(salts, on, "left").withColumn("__salt", drawn)
    copies = right.join(salts, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), width - 1)))
    return salted.drop("__salts").join(copies.drop("__salts"), [*on, "__salt"], how).drop("__salt")


def hot_keys(df: DataFrame, on: Sequence[str], most: int) -> DataFrame:
    """Keys with more than ``most`` rows and the number of salts that splits each into shares of that size."""
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most)
    return counted.withColumn("__salts", F.ceil(F.col("rows") / most).cast("int")).drop("rows")
