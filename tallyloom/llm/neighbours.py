"""Nearest neighbours by multi-index hashing of learned binary codes, reranked on the original vectors.

A bounded sample fits the codes: several rotations of the leading directions of
the data, each turned so that signs lose little (iterative quantisation). A code
is cut into substrings, and each substring of every code is indexed. By the
pigeonhole principle a code within a Hamming radius r of a query differs in at
most r // m bits in one of the m substrings, so looking up all values that near
retrieves every code within the radius; those are verified and reranked.

The radius follows from a bound: the k-th best cosine found so far, at first in
the sample, with a margin measured on the sample. Queries are stored in blocks
in the shared folder; every task indexes its own rows and reads the queries
block by block, so no vector has to find a bucket shared with others, and many
equal vectors are spread like any other rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.simhash import masks
from tallyloom.llm.store import read_bytes, task_count, write_bytes
from tallyloom.session import settle, work_folder

#: Vectors that fit the codes, about; chosen by a hash of vec_id.
SAMPLE_VECTORS = 4096
ROTATIONS, TURNS = 4, 20
#: Bits of one rotation, at most.
ROTATION_BITS = 64
#: Widths of substrings; each query takes the cheaper ones.
WIDTHS = (8, 16)
#: Share of near pairs of the sample that the margin must hold.
MARGIN = 0.985
#: Rows indexed together, and queries stored together.
INDEX_ROWS, QUERY_ROWS = 8192, 2048
#: Rows of one task.
TASK_ROWS = 100_000
#: Rows that a task searches at a time, however many it is given.
HELD_ROWS = 200_000


def _rows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows, their ids and vectors."""
    column = batch.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("row", "vec_id"))
    return (*ids, flat.reshape(-1, size))


def dots(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Products with one vector, row by row: equal rows give equal numbers wherever they stand, unlike a matrix product."""
    return (vectors * one).sum(axis=1)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass
class Codes:
    """Centre and directions of the codes, and the sample that bounds the radius."""

    centre: np.ndarray
    turns: np.ndarray  # dimension by bits
    sample_rows: np.ndarray
    sample: np.ndarray
    margin: float

    @property
    def bits(self) -> int:
        return self.turns.shape[1]

    def encode(self, units: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, as bytes."""
        return np.packbits((units - self.centre) @ self.turns > 0, axis=1)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """The Hamming radius that holds nearly all vectors with at least this cosine."""
        angle = np.arccos(np.clip(cosine, -1, 1))
        return np.clip(np.floor(self.bits * angle / np.pi + self.margin), 0, self.bits).astype(np.int64)


def fit(numbers: np.ndarray, vectors: np.ndarray, k: int, seed: int = 1) -> Codes:
    """Directions by principal components, turned by iterative quantisation from several random starts."""
    units = unit(vectors)
    centre = units.mean(axis=0)
    random = np.random.default_rng(seed)
    dimension = units.shape[1]
    width = min(ROTATION_BITS, dimension - dimension % 8 if dimension >= 8 else dimension)
    _, _, leading = np.linalg.svd(units - centre, full_matrices=True)
    reduced = (units - centre) @ leading[:width].T
    turns = []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(random.standard_normal((width, width)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
            turn = (left @ right).T
        turns.append(leading[:width].T @ turn)
    codes = Codes(centre, np.concatenate(turns, axis=1), numbers, units, 0.0)
    own = codes.encode(units)
    gaps = []
    for at in range(0, len(units), 512):
        cosine = units[at : at + 512] @ units.T
        cosine[np.arange(len(cosine)), at + np.arange(len(cosine))] = -2
        near = np.argsort(-cosine, axis=1)[:, : min(k, len(units) - 1)]
        rows = np.arange(len(cosine))[:, None]
        apart = np.bitwise_count(own[at : at + 512][rows] ^ own[near]).sum(axis=2)
        gaps.append((apart - codes.bits * np.arccos(np.clip(cosine[rows, near], -1, 1)) / np.pi).reshape(-1))
    gap = np.concatenate(gaps) if gaps else np.zeros(0)
    codes.margin = float(np.quantile(gap, MARGIN)) if len(gap) else 0.0
    return codes


class MultiIndex:
    """The substrings of a few thousand codes, sorted by value, for each width."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, {}
        n, size = codes.shape
        for width in WIDTHS:
            if size * 8 % width:
                continue
            values = codes if width == 8 else codes.reshape(n, -1, 2) @ np.array([256, 1])
            tables = []
            for column in values.T.astype(np.int64):
                order = np.argsort(column, kind="stable")
                tables.append((order, np.searchsorted(column[order], np.arange((1 << width) + 1))))
            self.tables[width] = tables

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius``."""
        n, size = self.codes.shape
        best = None
        for width, tables in self.tables.items():
            flips = min(radius // len(tables), width)
            ball = sum(comb(width, r) for r in range(flips + 1))
            cost = len(tables) * (ball * 4 + n * ball / 2**width)
            if best is None or cost < best[0]:
                best = (cost, width, flips)
        _, width, flips = best
        values = code if width == 8 else code.reshape(-1, 2) @ np.array([256, 1])
        near = _masks(width, flips)
        hit = np.zeros(n, dtype=bool)
        for value, (order, starts) in zip(values.tolist(), self.tables[width]):
            asked = near ^ value
            first, sizes = starts[asked], starts[asked + 1] - starts[asked]
            total = int(sizes.sum())
            if total:
                hit[order[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


_kept_masks: dict[tuple[int, int], np.ndarray] = {}


def _masks(width: int, flips: int) -> np.ndarray:
    if (width, flips) not in _kept_masks:
        _kept_masks[width, flips] = masks(width, flips).astype(np.int64)
    return _kept_masks[width, flips]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``vectors`` (vec_id, embedding, is_query) that take part, and their dimension.

    Left out: null ids and vectors, null or non-finite components, zero vectors,
    and vectors of another length than most rows have (the smaller on a tie).
    """
    item: Column = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), item.cast("array<double>").alias("embedding"), "is_query")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(~bad & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    size = most[0]["size"] if most else 0
    return rows.filter(F.size("embedding") == size), size


_PAIRS = "query long, query_id long, row long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, sample_vectors: int = SAMPLE_VECTORS) -> DataFrame:
    """The ``k`` nearest rows of every query row by cosine: query_id, rank (from 1), vec_id, score.

    A query's candidates are all rows but its own: other rows with its vec_id are
    candidates as well, and repeated candidates are found each. A repeated query
    row is a query of its own, so its id has ``k`` ranks per row. Ties go to the
    smaller vec_id. If the radius holds fewer than ``k`` rows, all rows of the
    block are compared, so that a query gets ``k`` neighbours where there are.
    Rows that ``usable`` leaves out take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, size = usable(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Drawn by the number of the row: equal ids or vectors must not be drawn together.
    share = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    chosen = sorted(rows.filter(share < max(sample_vectors / n, 0.0)).collect(), key=lambda row: row["row"])
    if len(chosen) < 2:
        chosen = rows.orderBy("vec_id", "row").limit(max(2, sample_vectors)).collect()
    codes = fit(np.array([r["row"] for r in chosen], dtype=np.int64), np.array([r["embedding"] for r in chosen], dtype=float), k)
    folder = work_folder(spark, "queries")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                numbers, ids, floats = _rows(batch.slice(at, QUERY_ROWS), size)
                units = unit(floats)
                cosine = units @ codes.sample.T
                cosine[numbers[:, None] == codes.sample_rows[None, :]] = -1
                bound = -np.sort(-cosine, axis=1)[:, k - 1] if cosine.shape[1] >= k else np.full(len(ids), -1.0)
                out = io.BytesIO()
                np.savez(out, numbers=numbers, ids=ids, floats=floats, codes=codes.encode(units), bound=bound)
                path = f"{folder}/{part}-{number}.npz"
                write_bytes(path, out.getvalue())
                number += 1
                yield pa.RecordBatch.from_pydict({"path": [path]})

    queries = rows.filter("is_query")
    held = queries.repartition(task_count(queries.count(), 8 * QUERY_ROWS))
    paths = sorted(row[0] for row in held.mapInArrow(store, "path string").collect())

    held_rows = HELD_ROWS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            parts.append(_rows(batch, size))
            if sum(len(part[0]) for part in parts) >= held_rows:
                yield from search_rows(parts)
                parts = []
        if parts:
            yield from search_rows(parts)

    def search_rows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        numbers, own, vectors_ = (np.concatenate(column) for column in zip(*parts))
        lengths = lengths_of(vectors_)
        blocks = []
        for at in range(0, len(own), INDEX_ROWS):
            part = slice(at, at + INDEX_ROWS)
            blocks.append((part, MultiIndex(codes.encode(vectors_[part] / lengths[part, None]))))
        for path in paths:
            data = np.load(io.BytesIO(read_bytes(path)))
            sizes = lengths_of(data["floats"]).tolist()
            out: tuple[list, ...] = ([], [], [], [], [])
            columns = (data["numbers"].tolist(), data["ids"].tolist(), data["floats"], data["codes"], data["bound"].tolist(), sizes)
            for number, query, vector, code, bound, length in zip(*columns):
                best_rows, best = np.zeros(0, np.int64), np.zeros(0)
                for part, index in blocks:
                    radius = int(codes.radius(np.array([bound]))[0])
                    near = part.start + index.probe(code, radius)
                    near = near[numbers[near] != number]
                    if len(near) + len(best) < k and len(best) < k:
                        near = part.start + np.flatnonzero(numbers[part] != number)
                    score = dots(vectors_[near], vector) / (lengths[near] * length)
                    best_rows, best = np.append(best_rows, near), np.append(best, score)
                    order = np.lexsort((numbers[best_rows], own[best_rows], -best))[:k]
                    best_rows, best = best_rows[order], best[order]
                    if len(best) == k:
                        bound = max(bound, float(best[-1]))
                out[0].append(np.full(len(best), number))
                out[1].append(np.full(len(best), query))
                out[2].append(numbers[best_rows])
                out[3].append(own[best_rows])
                out[4].append(best)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in out], names=["query", "query_id", "row", "vec_id", "score"])

    cores = spark.sparkContext.defaultParallelism
    dealt = rows.repartition(max(min(cores, task_count(n, INDEX_ROWS)), task_count(n, TASK_ROWS)))
    found = dealt.mapInArrow(search, _PAIRS)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
