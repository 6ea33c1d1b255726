"""Named datasets on storage, their splits, and simple sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .revisions import read_revision, revisions

# The columns of a training row, in this order.
TRAINING_COLUMNS = ["messages", "chosen", "rejected", "prompt", "completion", "label", "score"]


def split_kind(split: str) -> str:
    """``train`` or ``test``, whichever the name of the split contains first."""
    for kind in ("train", "test"):
        if kind in split:
            return kind
    raise ValueError(f"a split is named after train or test, unlike {split!r}")


def dataset_path(name: str, split: str, revision: str = "main", root: str = ".") -> str:
    """Names with ``data/`` in them are folders; others live below ``root``."""
    return f"{name}/{split}" if "data/" in name else f"{root}/{name}/{revision}/{split}"


def read_split(
    spark: SparkSession, name: str, split: str = "train", revision: str = "main", root: str = "."
) -> DataFrame:
    """One split of a dataset: by the manifests of its revisions if it has any, else by its folders."""
    if "data/" not in name and revisions(spark, name, root):
        return read_revision(spark, name, split, revision, root)
    return spark.read.parquet(dataset_path(name, split, revision, root))


def training_columns(df: DataFrame) -> list[Column]:
    """The training columns the table has; all others are not even read."""
    return [F.col(name) for name in TRAINING_COLUMNS if name in df.columns]


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
