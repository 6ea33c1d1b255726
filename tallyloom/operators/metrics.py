"""Small summaries of datasets and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_per_split(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def reported_samples(configured: int | None = None) -> Column:
    """Rows of a split, or the configured maximum if that is lower."""
    rows = F.count(F.lit(1))
    return rows if configured is None else F.least(F.lit(configured).cast("bigint"), rows)


def perplexity(loss: str) -> Column:
    """exp of the mean loss; too large a mean gives infinity."""
    return F.exp(F.avg(loss))


def evaluation_metrics(df: DataFrame, by: str, loss: str, max_samples: int | None = None) -> DataFrame:
    return df.groupBy(by).agg(
        reported_samples(max_samples).alias("eval_samples"),
        F.avg(loss).alias("eval_loss"),
        perplexity(loss).alias("perplexity"),
    )
