"""Votes over candidate files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.votes import tally, vote_from_tally

# Stored batches that are merged into one folder once there are more.
MERGE_EVERY = 50


def open_stream(spark: SparkSession, schema: StructType, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files as they arrive, at most ``max_files`` of them in a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def start_tally(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    problem: str,
    answer: str,
    order: str,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Tally every micro-batch and store the counts below ``out``.

    ``prepare`` turns raw rows into problem, answer (0..999 or null) and order
    columns. Counts and first places of batches can be merged in any order, so
    the candidates of a problem may be spread over files and batches, and no
    state is kept between them. A repeated batch overwrites its own folder.
    After ``merge_every`` batches their counts are merged into one folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = tally(prepare(batch), problem, answer, [order])
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if len(finished(batch.sparkSession, out)) > merge_every:
            merge_batches(batch.sparkSession, out, problem, answer, batch_id)

    # No rows as batch -1, so that the votes can be read before the first file.
    if not finished(stream.sparkSession, out):
        store(stream.sparkSession.createDataFrame([], stream.schema), -1)
    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finished(spark: SparkSession, out: str) -> list[str]:
    """The folders that count: the last merged one and the whole batches behind it.

    ``upto=<n>`` holds the batches up to ``n``. A folder counts once its writer
    has left the mark of a finished write, so a merge that broke off is not
    seen, and a batch that is repeated after its merge is passed over.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        return []
    found: dict[str, list[int]] = {"upto": [], "batch": []}
    for status in system.listStatus(path):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    done = max(found["upto"], default=None)
    merged = [] if done is None else [f"{out}/upto={done}"]
    return merged + [f"{out}/batch={n}" for n in sorted(found["batch"]) if done is None or n > done]


def _merged(spark: SparkSession, folders: list[str], problem: str, answer: str) -> DataFrame:
    return (
        spark.read.parquet(*folders)
        .groupBy(problem, answer)
        .agg(F.sum("vote_count").alias("vote_count"), F.min("first_seen").alias("first_seen"))
    )


def merge_batches(spark: SparkSession, out: str, problem: str, answer: str, last: int) -> None:
    """Merge everything stored so far into ``upto=<last>``; safe to repeat, older folders stay unread."""
    folders = finished(spark, out)
    if f"{out}/upto={last}" in folders:
        return
    _merged(spark, folders, problem, answer).write.mode("overwrite").parquet(f"{out}/upto={last}")


def current_votes(spark: SparkSession, out: str, problem: str, answer: str, target: str = "answer") -> DataFrame:
    """Majority votes over all batches stored so far."""
    return vote_from_tally(_merged(spark, finished(spark, out), problem, answer), problem, answer, target)
