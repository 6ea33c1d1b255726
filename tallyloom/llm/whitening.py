"""Whitening of vectors: exact scatter in Spark, pivoted Cholesky, one-sided Jacobi on the factor.

Entries become whole numbers first, so all sums are exact and do not depend on
the order of rows, tasks or retries:

1. One pass gives the number of vectors and the sum of every dimension.
2. A second one centres every vector by whole numbers and adds up products.
   Blocks are multiplied in double precision as long as no sum can leave its
   53 exact bits, else in Python's integers.
3. The covariance, correctly rounded from those sums, is factorised by Cholesky
   with diagonal pivots. Jacobi rotations from the right make the columns of the
   factor orthogonal: their norms are the square roots of the eigenvalues, and
   the normalised columns are the components.
4. Every vector is projected where it is.

The driver holds the covariance only, dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Vectors multiplied together.
BLOCK_ROWS = 8192
#: Whole numbers up to here are exact in double precision.
EXACT = 2**53
#: Off-diagonal cosines below this count as zero, and sweeps over all pairs at most.
COSINE, SWEEPS = 1e-15, 60
#: A pivot below this share of the first one is rounding.
RANK_SHARE = 1e-14


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` finds: vectors, sums, components (rows) by falling eigenvalue, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    #: No deviation is larger.
    most_deviation: int


def remaining(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, has entries, and holds finite numbers only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def whole_numbers(vectors: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """Vectors of one length as int64 rows; other lengths, or entries beyond 2**53 / SCALE, raise."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes[0]) if dimensions is None else dimensions
    if (sizes != width).any():
        raise ValueError("the vectors differ in length")
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() > EXACT - SHIFT:
        raise ValueError("an entry is too large to become an exact whole number")
    return scaled.astype(np.int64).reshape(-1, width) + SHIFT


def _blocks(batch: pa.RecordBatch, dimensions: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        part = batch.slice(start, BLOCK_ROWS)
        yield part, whole_numbers(part.column("vector"), dimensions)


def products(rows: np.ndarray) -> list[list[int]]:
    """Sums of products of all pairs of columns, exact."""
    most = int(np.abs(rows).max(initial=0))
    if most * most >= EXACT:
        wide = rows.astype(object)
        return wide.T.dot(wide).tolist()
    height = max(1, min(len(rows), (EXACT - 1) // max(1, most * most)))
    total = np.zeros((rows.shape[1], rows.shape[1]), dtype=object)
    for start in range(0, len(rows), height):
        part = rows[start : start + height].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total.tolist()


def _sums(vectors: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Number of vectors, and the sum, least and greatest of every dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for batch in batches:
            for _, rows in _blocks(batch):
                wide = rows.astype(object).sum(axis=0) if np.abs(rows).max() > 2**49 else rows.sum(axis=0).astype(object)
                if total is None:
                    total, low, high = wide, rows.min(axis=0), rows.max(axis=0)
                elif len(total) != len(wide):
                    raise ValueError("the vectors differ in length")
                else:
                    total, low, high = total + wide, np.minimum(low, rows.min(axis=0)), np.maximum(high, rows.max(axis=0))
                n += len(rows)
        if n:
            width = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(width), pa.int32()),
                    pa.array([n] * width, pa.int64()),
                    pa.array([Decimal(x) for x in total], pa.decimal128(38, 0)),
                    pa.array(low, pa.int64()),
                    pa.array(high, pa.int64()),
                ],
                names=["dimension", "n", "total", "low", "high"],
            )

    found = (
        vectors.mapInArrow(partial, "dimension int, n long, total decimal(38,0), low long, high long")
        .groupBy("dimension")
        .agg(F.sum("n"), F.sum("total"), F.min("low"), F.max("high"))
        .collect()
    )
    found.sort()
    if len({row[1] for row in found}) > 1:
        raise ValueError("the vectors differ in length")
    n = found[0][1] if found else 0
    return n, [int(row[2]) for row in found], [row[3] for row in found], [row[4] for row in found]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, every entry correctly rounded from exact sums.

    Vectors are centred by the whole part of their mean before they are
    multiplied; the rest of the mean is taken off the exact sums.
    """
    centre = [total // n for total in sums]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, rows in _blocks(batch, len(centre)):
                found = np.array(products(rows - np.array(centre, dtype=np.int64)), dtype=object)
                total = found if total is None else total + found
        if total is not None:
            # One row of the matrix at a time, its upper part.
            for i in range(len(centre)):
                width = len(centre) - i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i] * width, pa.int32()),
                        pa.array(range(i, len(centre)), pa.int32()),
                        pa.array([Decimal(x) for x in total[i, i:]], pa.decimal128(38, 0)),
                    ],
                    names=["i", "j", "total"],
                )

    matrix = np.zeros((len(centre), len(centre)))
    rest = [total - n * c for total, c in zip(sums, centre)]
    added = vectors.mapInArrow(partial, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total"))
    for i, j, total in added.collect():
        matrix[i, j] = matrix[j, i] = (n * int(total) - rest[i] * rest[j]) / (n * n)
    return matrix


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``factor`` and ``order`` with ``matrix[order][:, order] = factor @ factor.T``.

    The largest diagonal left is the next pivot, so the factor has as many
    columns as the matrix has rank.
    """
    rest = matrix.astype(np.float64).copy()
    size = len(rest)
    order = np.arange(size)
    factor = np.zeros((size, size))
    first = rest.diagonal().max(initial=0.0)
    for k in range(size):
        p = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[p, p] <= first * RANK_SHARE:
            return factor[:, :k], order
        for whole in (rest, rest.T, factor, order):
            whole[[k, p]] = whole[[p, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray) -> np.ndarray:
    """Turn the columns of ``factor`` by rotations from the right until they are orthogonal.

    A round turns disjoint pairs at once, as in a tournament where everyone
    meets everyone, so that a sweep is as many rounds as there are columns.
    """
    turned = factor.copy()
    width = turned.shape[1]
    if width < 2:
        return turned
    seats = list(range(width + width % 2))
    for _ in range(SWEEPS):
        largest = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a < width and b < width]
            left, right = np.array(pairs).T
            a, b = turned[:, left], turned[:, right]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
            largest = max(largest, cosine.max(initial=0.0))
            live = cosine > COSINE
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=live)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            tangent[~live] = 0.0
            c = 1.0 / np.hypot(1.0, tangent)
            s = c * tangent
            turned[:, left], turned[:, right] = c * a - s * b, s * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if largest <= COSINE:
            break
    return turned


def components_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as rows, and eigenvalues, largest first; directions without variance are left out.

    Of the two signs the one is taken that makes the largest entry positive.
    """
    factor, order = pivoted_cholesky(matrix)
    turned = np.zeros_like(factor)
    turned[order] = jacobi(factor)
    values = (turned * turned).sum(axis=0)
    ranked = np.argsort(-values, kind="stable")
    ranked = ranked[values[ranked] > 0]
    vectors = (turned[:, ranked] / np.sqrt(values[ranked])).T
    largest = np.abs(vectors).argmax(axis=1) if len(vectors) else np.zeros(0, dtype=np.int64)
    signs = np.sign(vectors[np.arange(len(vectors)), largest])
    return vectors * signs[:, None], values[ranked]


def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """Components of all remaining vectors.

    Vectors that are null, empty or hold null or non-finite entries take no
    part. Without vectors, or if all are equal, there are no components.
    Vectors of different lengths raise, so do entries above about 10**14.
    """
    vectors = remaining(df, vector).select(F.col(vector).cast("array<double>").alias("vector"))
    n, sums, low, high = _sums(vectors)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    matrix = covariance(vectors, n, sums)
    found, values = components_of(matrix)
    most = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums))
    return Whitening(n, tuple(sums), found, values, float(np.trace(matrix)), most)


def _projected(rows: np.ndarray, model: Whitening, count: int) -> np.ndarray:
    """Whitened coordinates: centred exactly, then projected."""
    centre = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([(s - model.n * int(c)) / model.n for s, c in zip(model.sums, centre)])
    return ((rows - centre).astype(np.float64) - rest) @ model.components[:count].T / np.sqrt(model.eigenvalues[:count])


def _deviations(rows: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S) squared, exact; null where it does not fit a long."""
    if model.most_deviation < 2**63:
        far = rows * model.n - np.array(model.sums, dtype=np.int64)
        return pa.array((far * far).sum(axis=1), pa.int64())
    far = rows.astype(object) * model.n - np.array(model.sums, dtype=object)
    return pa.array([x if x < 2**63 else None for x in (far * far).sum(axis=1)], pa.int64())


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding", components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
    count = min(components, len(model.eigenvalues))
    if not count:
        return 0.0
    vectors = remaining(df, vector).select(F.col(vector).cast("array<double>").alias("vector"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for _, rows in _blocks(batch, len(model.sums)):
                white = _projected(rows, model, count)
                total += white.sum(axis=0)
                square += white.T @ white
        for i in range(count):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * (count + 1), pa.int32()),
                    pa.array(range(-1, count), pa.int32()),
                    pa.array(np.concatenate([total[i : i + 1], square[i]])),
                ],
                names=["i", "j", "total"],
            )

    added = vectors.mapInArrow(partial, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total"))
    sums = np.zeros((count, count + 1))
    for i, j, total in added.collect():
        sums[i, j + 1] = total
    mean = sums[:, 0] / model.n
    found = sums[:, 1:] / model.n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(count)).max())


def whiten(df: DataFrame, model: Whitening, key: str, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector: key, ``deviation`` and ``whitened``, the array of its coordinates.

    Null, repeated or tied keys make no difference, every row is projected by
    itself; other columns are left out. ``deviation`` is null where the exact
    sum does not fit a long.
    """
    count = min(components, len(model.eigenvalues))
    rows = remaining(df, vector).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, numbers in _blocks(batch, len(model.sums)):
                white = _projected(numbers, model, count)
                offsets = pa.array(np.arange(0, white.size + 1, count or 1, dtype=np.int32)[: len(numbers) + 1])
                if not count:
                    offsets = pa.array(np.zeros(len(numbers) + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), _deviations(numbers, model), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))],
                    names=["key", "deviation", "whitened"],
                )

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(project, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def whitened_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: key, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    model = fit(df, vector)
    error = identity_error(df, model, vector, components)
    shares = [float(value / model.trace) for value in model.eigenvalues[:components]]
    table = F.array(*[F.lit(share) for share in shares]) if shares else F.array().cast("array<double>")
    return (
        whiten(df, model, key, vector, components)
        .select(key, "deviation", F.posexplode("whitened").alias("place", "whitened"))
        .select(
            key,
            (F.col("place") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(table, F.col("place")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
