"""Embedding whitening from an exact integer scatter.

1. Entries become whole numbers; each task subtracts a shift and adds up sums and cross-products
   without rounding: entries are cut into signed limbs of 20 bits, whose products a float matrix
   product adds exactly for so many rows, and Python's integers carry the totals.
2. Totals leave a task in limbs of 30 bits, one row for each entry of the matrix and limb, so that SQL
   sums of longs add them exactly, with map-side combine.
3. n·XᵀX − SSᵀ is formed in whole numbers; only then it becomes floating point and is decomposed.
4. A second pass projects every vector; the covariance of what comes out is measured, not assumed.

To the driver come the sums alone: d·(d + 3) / 2 numbers for vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb inside a task, and rows whose products of limbs a double adds exactly: 2 * (20 - 1) + 15 = 53.
LIMB, EXACT_ROWS = 20, 1 << 15
#: Bits of a limb in which totals travel.
OUT = 30
#: Entries must be below this, so that whole numbers fit a long.
LARGEST = float(1 << 51)


def usable(vector: str):
    """Vectors that are not null or empty and hold finite entries alone."""
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & fine


def _whole(column: pa.Array, shift: int, size: int | None = None) -> np.ndarray:
    """Whole numbers less the shift, a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    size = size or int(width[0])
    if (width != size).any():
        raise ValueError(f"vectors of one table have one length: {size}, but there is one of {int(width[width != size][0])}")
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"entries of {LARGEST:.0f} or more don't fit whole numbers of 64 bits")
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size) + (OFFSET - shift)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as a sum of limbs[k] << LIMB * k with limbs of at most 1 << LIMB - 1 in size."""
    out, half = [], 1 << LIMB - 1
    while True:
        low = (x + half & (1 << LIMB) - 1) - half
        out.append(low.astype(np.float64))
        x = x - low >> LIMB
        if not x.any():
            return out


def cross(x: np.ndarray) -> np.ndarray:
    """XᵀX in Python's integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), EXACT_ROWS):
        parts = limbs(x[at : at + EXACT_ROWS])
        for a, one in enumerate(parts):
            for b, other in enumerate(parts):
                product = (one.T @ other).astype(np.int64).astype(object)
                total = total + (product << LIMB * (a + b) if a + b else product)
    return total


def _cut(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while not -(1 << OUT) < value < 1 << OUT:
        yield k, value & (1 << OUT) - 1
        value >>= OUT
        k += 1
    yield k, value


def _summed(shift: int):
    """Of a partition: limbs of the number of vectors (row -1, col -1), of the sums (row -1) and of the cross-products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, both = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0), shift)
                if n and len(sums) != x.shape[1]:
                    raise ValueError(f"vectors of one table have one length: {len(sums)}, but there is one of {x.shape[1]}")
                n, sums, both = n + len(x), sums + x.astype(object).sum(0), both + cross(x)
        if n:
            d = len(sums)
            entries = [(-1, -1, n), *((-1, j, sums[j]) for j in range(d)), *((i, j, both[i, j]) for i in range(d) for j in range(i, d))]
            rows = [(i, j, k, limb) for i, j, value in entries for k, limb in _cut(int(value))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["i", "j", "k", "limb"])

    return run


@dataclass
class Scatter:
    """n vectors, per dimension the sums S of their whole numbers less ``shift``, and n·XᵀX − SSᵀ; exact."""

    n: int
    shift: int
    sums: np.ndarray
    matrix: np.ndarray

    def decomposed(self, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit eigenvectors of the covariance (columns) by falling eigenvalue, the eigenvalues, and their shares of
        the trace. Of the two directions of a vector, the one whose largest entry is positive."""
        d = len(self.sums)
        square = self.n * self.n
        covariance = np.array([[int(v) / square for v in row] for row in self.matrix], float).reshape(d, d)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        top = vectors[np.abs(vectors).argmax(0), np.arange(len(order))]
        trace = sum(int(self.matrix[i, i]) for i in range(d)) / square
        return vectors * np.where(top < 0, -1, 1), values, values / trace if trace else np.full(len(values), np.nan)

    def floor(self, values: np.ndarray) -> float:
        """Eigenvalues up to this are 0 to double precision."""
        return float(np.finfo(float).eps * len(self.sums) * values.max(initial=0))


def scatter(vectors: DataFrame, vector: str = "embedding", shift: int = OFFSET) -> Scatter:
    """The scatter of all usable vectors of a table. Any shift gives the same matrix."""
    rows = prepare(vectors.sparkSession) and vectors.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    sums = rows.mapInArrow(_summed(shift), "i int, j int, k int, limb long").groupBy("i", "j", "k").agg(F.sum("limb").alias("limb")).collect()
    total: dict[tuple[int, int], int] = {}
    for i, j, k, limb in sums:
        total[i, j] = total.get((i, j), 0) + (limb << OUT * k)
    n, d = total.get((-1, -1), 0), max((j for _, j in total), default=-1) + 1
    s = np.array([total[-1, j] for j in range(d)], object)
    matrix = np.array([[n * total[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)], object).reshape(d, d)
    return Scatter(n, shift, s, matrix)


def _projected(n: int, shift: int, sums: list[int], axes: np.ndarray):
    """Of each vector the sum of its squared (n·x − S), and its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column("v"), shift, len(sums))
            largest = n * int(np.abs(x).max()) + max(map(abs, sums))
            own = n * x - np.array(sums, np.int64) if largest < 1 << 62 else n * x.astype(object) - np.array(sums, object)
            if largest * largest * len(sums) < 1 << 63:
                deviation = pa.array((own * own).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                exact = (own.astype(object) ** 2).sum(1)
                deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            flat = ((own / n).astype(float) @ axes).ravel()
            white = pa.FixedSizeListArray.from_arrays(pa.array(flat, mask=np.isnan(flat)), axes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), deviation, white], ["key", "deviation", "white"])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    An entry c counts as floor(1024·c) + 100000. Vectors that are null, empty, or hold null or non-finite
    entries are left out; the other n vectors are the fit list. ``deviation`` decimal(38, 0) is the sum
    over dimensions of (n·x − S)², exact (null from 10^38); ``whitened`` the projection of x − S/n on the
    component over the root of its eigenvalue; ``explained`` its share of the trace; ``identity_error`` the
    largest absolute entry of the measured covariance of ``whitened`` less the identity.

    A component whose eigenvalue is 0 to double precision (constant vectors, fewer vectors than
    components) has null in ``whitened`` and doesn't count in ``identity_error``; without any
    variance ``explained`` and ``identity_error`` are null. With fewer than ``components`` dimensions there are
    as many components as dimensions. Null keys and rows that repeat a key are vectors of their own. An
    empty table gives no rows. Vectors of different lengths, or entries of 2^51 or more, are an error.
    Other columns are not read.
    """
    found = scatter(vectors, vector)
    kind = dict(vectors.dtypes)[key]
    if not found.n:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double")
    axes, values, explained = found.decomposed(components)
    some = values > found.floor(values)
    axes = np.where(some, axes / np.sqrt(np.where(some, values, 1)), np.nan)
    rows = vectors.where(usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    work = _projected(found.n, found.shift, [int(v) for v in found.sums], axes)
    out = stored(rows.mapInArrow(work, f"key {kind}, deviation decimal(38, 0), white array<double>"), "whitened")

    pairs = [(a, b) for a in np.flatnonzero(some).tolist() for b in np.flatnonzero(some).tolist() if a <= b]
    error = None
    if pairs:
        measured = out.agg(*(F.covar_pop(F.col("white")[a], F.col("white")[b]) for a, b in pairs)).first()
        error = max(abs(v - (a == b)) for v, (a, b) in zip(measured, pairs))
    shares = F.array(*(F.lit(None if np.isnan(v) else float(v)).cast("double") for v in explained))
    out = out.select("key", "deviation", F.posexplode("white").alias("at", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
