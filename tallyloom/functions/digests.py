"""A seeded order that is the same on every cluster, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column


def seeded_digest(seed: int, *keys: Column | str) -> Column:
    """md5 of seed and key; sorting by it permutes rows with distinct keys."""
    parts = [as_column(key).cast("string") for key in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def digest_bucket(digest: Column | str, hex_digits: int = 4) -> Column:
    """Leading digits: equal-sized, ordered ranges of the digest order."""
    return F.left(as_column(digest), F.lit(hex_digits))


def digest_share(digest: Column | str) -> Column:
    """The digest as a number in 0..1, read from its first eight hex digits."""
    return F.conv(F.left(as_column(digest), F.lit(8)), 16, 10).cast("double") / float(16**8)
