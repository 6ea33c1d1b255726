"""The order in which a reader meets rows: files by path, rows as they lie in a file.

A table read straight from Parquet files needs no order column for this. Row
counts come from the footers of the files, and a prefix is a comparison of the
path and of the place in the file, so files behind the cut are never opened.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import BROADCAST_ROWS

PATH, ROW = "_metadata.file_path", "_metadata.row_index"


def file_rows(df: DataFrame) -> list[tuple[str, int]]:
    """Every file that holds rows and their number, in reader order.

    No column is read, only footers. The driver gets one row per file, as it
    does whenever a table is listed.
    """
    try:
        counted = df.groupBy(F.col(PATH).alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    except AnalysisException as error:
        raise ValueError("reader order needs a table that is read straight from files") from error
    return sorted((row.path, row.rows) for row in counted.collect())


def reader_prefix(df: DataFrame, k: int, files: list[tuple[str, int]] | None = None) -> DataFrame:
    """The first ``min(k, rows)`` rows in reader order.

    ``files`` may hold what ``file_rows`` found. Only the file with the cut is
    read in part; of the ones behind it nothing is read.
    """
    before = 0
    for path, rows in file_rows(df) if files is None else files:
        if before + rows >= k > before:
            inside = (F.col(PATH) < path) | (F.col(ROW) < k - before)
            # The path alone once more: this comparison leaves out whole files.
            return df.filter((F.col(PATH) <= path) & inside)
        before += rows
    return df.filter(F.lit(False)) if k <= 0 else df


def reader_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """The first ``int(fraction * rows)`` rows in reader order."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction lies between 0 and 1, unlike {fraction}")
    files = file_rows(df)
    return reader_prefix(df, int(fraction * sum(rows for _, rows in files)), files)


def with_reader_place(df: DataFrame, target: str = "place", files: list[tuple[str, int]] | None = None) -> DataFrame:
    """Add the place of every row in reader order, from 0; nothing is sorted or shuffled.

    Rows before a file are looked up in a table of all files, of 16 bytes each,
    which is broadcast up to ``BROADCAST_ROWS`` files.
    """
    before, offsets = 0, []
    for path, rows in file_rows(df) if files is None else files:
        offsets.append((path, before))
        before += rows
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "path string, before long").select(F.xxhash64("path").alias("__file"), "before")
    if table.select(F.count_distinct("__file")).first()[0] != len(offsets):
        raise ValueError("two paths share a hash")
    if len(offsets) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    marked = df.withColumns({"__file": F.xxhash64(F.col(PATH)), "__row": F.col(ROW)})
    return marked.join(table.withColumnRenamed("before", "__before"), "__file").select(
        *df.columns, (F.col("__before") + F.col("__row")).alias(target)
    )
