"""Token ids on disk: fixed-size blocks of ids, transposed into planes, each plane compressed.

A shard file holds, in this order, the compressed planes of all blocks, then a
footer in JSON (the chunk index: for every block its number of ids, its offset
and the length of each compressed plane; the documents and their numbers of
ids), then the footer's length and a magic word. Planes are byte planes or bit
planes of little-endian unsigned 32-bit ids; the upper ones of a vocabulary
below 65,536 are all zero and shrink to a few bytes.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.store import read_bytes, slices, task_count, text_bytes, write_bytes
from tallyloom.llm.subwords import BLOCK_BYTES, encoder
from tallyloom.session import settle, work_folder

MAGIC = b"TLPLANE1"
BLOCK_IDS = 65_536
#: Bytes of text that become one shard file.
SHARD_BYTES = 16 * 1024 * 1024
#: A task whose range holds more than this share of ``SHARD_BYTES`` writes several files.
FILE_SHARE = 2
#: No more tasks than this; beyond them each writes more files.
MOST_SHARDS = 200_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block, lowest first."""
    table = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(table[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: Sequence[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of one block of ``n``."""
    if kind == "byte":
        table = np.stack([np.frombuffer(plane, dtype=np.uint8) for plane in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(plane, dtype=np.uint8), bitorder="little", count=n) for plane in planes]
        table = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(table).view("<u4").reshape(-1)


def pack_shard(pieces: Iterator[np.ndarray], documents: list[list], kind: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """The bytes of a shard file; ``documents`` is filled by the one who yields the pieces."""
    press = zstandard.ZstdCompressor(level=level)
    body, index, rest, held, offset = [], [], [], 0, 0

    def add(ids: np.ndarray) -> None:
        nonlocal offset
        planes = [press.compress(plane) for plane in to_planes(ids, kind)]
        index.append([len(ids), offset, *map(len, planes)])
        body.extend(planes)
        offset += sum(map(len, planes))

    for piece in pieces:
        rest.append(piece)
        held += len(piece)
        if held >= block:
            ids = np.concatenate(rest)
            whole = held - held % block
            for at in range(0, whole, block):
                add(ids[at : at + block])
            rest, held = [ids[whole:]], held - whole
    if held:
        add(np.concatenate(rest))
    footer = json.dumps({"kind": kind, "chunks": index, "documents": documents}).encode()
    return b"".join([*body, footer, len(footer).to_bytes(8, "little"), MAGIC])


def footer_of(data: bytes) -> dict:
    """The chunk index and document list of a shard file."""
    if data[-8:] != MAGIC:
        raise ValueError("not a plane file")
    size = int.from_bytes(data[-16:-8], "little")
    return json.loads(data[-16 - size : -16])


def read_ids(data: bytes, start: int, stop: int, footer: dict | None = None) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a shard; only the blocks they lie in are decompressed."""
    footer = footer or footer_of(data)
    open_plane = zstandard.ZstdDecompressor()
    first, found = 0, [np.zeros(0, dtype="<u4")]
    for n, offset, *lengths in footer["chunks"]:
        if first < stop and first + n > start:
            planes, at = [], offset
            for length in lengths:
                planes.append(open_plane.decompress(data[at : at + length]))
                at += length
            ids = from_planes(planes, n, footer["kind"])
            found.append(ids[max(0, start - first) : stop - first])
        first += n
    return np.concatenate(found)


#: Characters of a text that deal out rows of one doc_id.
RANGE_CHARS = 64


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, kind: str = "byte", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and write files of about ``shard_bytes`` of text.

    A null text is empty and holds the end id alone; rows without a doc_id
    come first; rows of one doc_id follow each other by their text. A task
    writes its range of ids as one file after the other and holds one of them,
    however large the range is. A task that runs again writes the same files
    again. Returns the manifest, a row per file: ``shard`` and ``file`` give the
    order, then path, documents, ids, and the ids of all files ``before``.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = task_count(text_bytes(narrow), shard_bytes, MOST_SHARDS)
    # The begin of the text as well, so that one doc_id with many rows is spread.
    ordered = narrow.repartitionByRange(parts, "doc_id", F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        file, documents, pieces, size = 0, [], [], 0

        def store() -> pa.RecordBatch:
            path = f"{folder}/shard-{shard:06d}-{file:06d}.planes"
            write_bytes(path, pack_shard(iter(pieces), documents, kind))
            row = {"shard": [shard], "file": [file], "path": [path], "documents": [len(documents)], "ids": [sum(n for _, n in documents)]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in slices(batch, "text", min(BLOCK_BYTES, shard_bytes)):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                encoded = coder.encode(texts)
                documents.extend([d, len(e) + 1] for d, e in zip(part.column("doc_id").to_pylist(), encoded))
                pieces.append(np.concatenate([x for e in encoded for x in (e, end)]))
                # Empty texts count as well: each is an id and an entry of the list.
                size += sum(map(len, texts)) + 16 * len(texts)
                if size >= FILE_SHARE * shard_bytes:
                    yield store()
                    file, documents, pieces, size = file + 1, [], [], 0
        if documents:
            yield store()

    written = settle(ordered.mapInArrow(write, "shard long, file long, path string, documents long, ids long"))
    # One number per task reaches the driver, whatever the number of files.
    sums = sorted(map(tuple, written.groupBy("shard").agg(F.sum("ids")).collect()))
    before = dict(zip([shard for shard, _ in sums], itertools.accumulate([0, *[ids for _, ids in sums]])))
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "shard long, earlier long")
    inside = F.sum("ids").over(Window.partitionBy("shard").orderBy("file")) - F.col("ids")
    found = written.join(F.broadcast(offsets), "shard")  # at most MOST_SHARDS rows of two numbers
    return found.select("shard", "file", "path", "documents", "ids", (F.col("earlier") + inside).alias("before"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents from the files of a manifest: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                data = read_bytes(path)
                footer = footer_of(data)
                keys, counts = zip(*footer["documents"])
                counts = np.array(counts, dtype=np.int64)
                ends = np.cumsum(counts)
                ids = read_ids(data, 0, int(ends[-1]), footer)
                sums = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(keys, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # Sorted and stored: tasks deal the files out alike when they run again.
    places = settle(shards.select("path", "before").orderBy("path"))
    return places.repartition(task_count(places.count(), 1, MOST_SHARDS)).mapInArrow(read, schema)


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, kind: str = "byte", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write ``docs`` as plane files in the shared folder and describe what the files hold."""
    spark = docs.sparkSession
    folder = work_folder(spark, "planes")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, kind, shard_bytes))
