"""Packing of documents into fixed-length sequences: first-fit decreasing in random groups.

Full-length pieces of long documents are sequences of their own. What is left
of every document is dealt at random into groups of bounded size; each group is
packed by itself: longest piece first, each into the first bin with room, found
in a tournament tree of the bins' free space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import slices, task_count
from tallyloom.llm.subwords import BLOCK_BYTES, encoder
from tallyloom.session import settle

SEQUENCE = 2048
#: Pieces that are packed together; more of them leave less padding.
GROUP_PIECES = 50_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; ``sizes`` must be sorted, longest first.

    ``free`` is a complete binary tree: the leaves hold the free space of the
    bins, every inner node the larger of its two children. The first bin with
    room is found by going down from the root, to the left wherever that fits.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes.tolist():
        if size > capacity:
            raise ValueError("a piece is longer than a sequence")
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= size
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and cut them every ``sequence`` ids: one row per piece.

    A null text is empty and becomes one piece that holds the end id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                rows = []
                encoded = coder.encode(part.column("text").cast(pa.binary()).to_pylist())
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), sequence):
                        piece = ids[at : at + sequence]
                        rows.append((doc, at, len(piece), zlib.crc32(piece), len(ids)))
                columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def pack(cut: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a column ``length``.

    The pieces are stored first, with a number of their own: groups are drawn by
    a hash of that number, so repeated rows and one very frequent document are
    spread like any other, and a lost executor changes no group.
    """
    stored = settle(cut.withColumn("__piece", F.monotonically_increasing_id()))
    whole = F.col("length") == sequence
    rest = stored.filter(~whole)
    count = rest.count()
    # Groups are no tasks: their number has no bound, so that their size has one.
    groups = task_count(count, group_pieces, max(count, 1))
    dealt = rest.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "__piece"), F.lit(groups)))

    kept = [*cut.columns, "sequence_id", "offset"]

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "__piece"], ascending=[False, True], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), sequence)
        frame["sequence_id"] = (frame["__group"].to_numpy() * (1 << 32) + bins) * 2
        frame["offset"] = offsets
        return frame[kept]

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in cut.dtypes)
    packed = dealt.groupBy("__group").applyInPandas(fill, f"{kinds}, sequence_id long, offset long")
    full = stored.filter(whole).select(
        *cut.columns, (F.col("__piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece of its end id. Repeated rows and null
    doc_ids are packed each; pieces of one length are taken in the order they
    are stored in. An empty table gives no rows; other columns are left out.
    """
    return pack(pieces(docs, tokenizer, end_id, sequence), sequence, group_pieces)
