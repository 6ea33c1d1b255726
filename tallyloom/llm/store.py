"""Files in the folder that driver and executors share, and sizes taken from the data."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task of a costly stage should hold.
TASK_BYTES = 16 * 1024 * 1024
#: No stage is cut into more tasks than this; tasks then grow with the input.
MOST_TASKS = 20_000


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file under a passing name and move it, so that a repeated task leaves one whole file."""
    system, path = _place(uri)
    folder = path.rsplit("/", 1)[0]
    system.create_dir(folder, recursive=True)
    passing = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(data)
    system.move(passing, path)


def read_bytes(uri: str) -> bytes:
    system, path = _place(uri)
    with system.open_input_stream(path) as source:
        return source.read()


def local_path(uri: str) -> str | None:
    """The path by which this machine can map a file, None if the store is remote."""
    system, path = _place(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate over the column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def task_count(size: int, each: int = TASK_BYTES, most: int = MOST_TASKS) -> int:
    """Into how many parts of about ``each`` a stage is cut."""
    return max(1, min(most, math.ceil(size / each)))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer text stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, start + 4096)
        yield batch.slice(start, stop - start)
        start = stop


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per session, so that their Python workers can import it."""
    context = spark.sparkContext
    name = "tallyloom-llm.zip"
    if name not in context._python_includes:
        top = Path(__file__).resolve().parents[2]
        packed = Path(tempfile.mkdtemp()) / name
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted((top / "tallyloom").rglob("*.py")):
                out.write(source, source.relative_to(top))
        context.addPyFile(str(packed))
    return spark
