"""Whitening of embeddings by the leading components of their covariance.

Entries become integers, ``floor(256 * c)``. The covariance is taken over each distinct vector
once (the fit list), so that repeated rows do not weigh.

Method: FEAST. Inertia counts of the shifted covariance locate an interval that holds the wanted
eigenvalues. A contour around it is integrated by Gauss-Legendre quadrature: at each node the
complex shifted covariance is solved against a block of vectors, and the weighted sum projects
the block onto the interval's eigenspace. Rayleigh-Ritz on that space gives the pairs, which are
the next block until residuals vanish. The count of pairs found is held against the inertia
count; where one is missing the block grows.

Scale: distinct vectors, sums, centred products and scores are Spark jobs; a task holds one
Arrow batch and sums of d or d x d numbers. Per task the products leave as d rows and are added
up by row. Only sums, the d x d covariance and the components (d x 4) pass through the driver;
they are bounded by the vector's length, not by the data. The shifted solves of a contour are
independent and run as tasks, one node each.

Defined cases: a row whose vector is null or holds a null or non-finite entry is left out;
null and repeated ids stay. Vectors of another length than the most frequent one of the fit list
(ties: the longest) take no part in the fit and return null measures. Directions without
variance are no components, so there are min(4, rank) of them and no rows at all where no
vector differs from another. A deviation beyond a long is null. Integers beyond a long saturate.
The component's largest coefficient (the first of equals) is positive. Columns other than the id
and the vector are not read.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import written

SCALE = 256
COMPONENTS = 4
#: Quadrature nodes on the upper half of a contour, and rounds before the block grows.
NODES = 8
ROUNDS = 12
#: Residual, relative to the trace, at which a pair counts as found.
TOLERANCE = 2e-15
SEED = 20
_LONG = 2 ** 63 - 1


# --- vectors -----------------------------------------------------------------------------

def integers(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, x) of the rows whose entries are all finite numbers."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return df.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("key"), x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def totals(x: np.ndarray) -> list[int]:
    """Sums of the columns, exact."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) > _LONG // len(x):
        return [sum(map(int, column)) for column in x.T]
    return [int(s) for s in x.sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n. The whole part of the mean is taken off in integers, so large entries keep their digits."""
    whole = [s // n for s in sums]
    part = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) > _LONG // 2:
        return (x.astype(object) - np.array(whole, object)).astype(float) - part
    return (x - np.array(whole, np.int64)).astype(float) - part


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the columns of (n*x - S)^2, exact; null beyond a long."""
    if not len(x):
        return []
    widest = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
    if widest ** 2 * max(len(sums), 1) <= _LONG:
        y = x * n - np.array(sums, np.int64)
        return [int(v) for v in (y * y).sum(axis=1)]
    y = x.astype(object) * n - np.array(sums, object)
    return [v if v <= _LONG else None for v in (y * y).sum(axis=1)]


# --- sums over the fit list --------------------------------------------------------------

def length_of(fit: DataFrame) -> int:
    """The most frequent length of a vector, the longest of equally frequent ones; 0 if there is none."""
    sizes = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    best = sizes.agg(F.max(F.struct("rows", "d")).alias("best")).first().best
    return best.d if best else 0


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(plain(batch, "x"), d)
            n, sums = n + len(x), [a + b for a, b in zip(sums, totals(x))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
                                          "s": pa.array(sums, pa.decimal128(38, 0))})
    rows = fit.mapInArrow(part, "i int, n long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows.sort(key=lambda r: r.i)
    return rows[0].n, [int(r.s) for r in rows]


def products(fit: DataFrame, n: int, sums: list[int], axes: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the centred vectors, or of their coordinates on ``axes``, divisor ``n``.

    Each task adds up its own products and sends one row per row of the matrix; rows of all
    tasks are added up by their number, in the order of the partitions.
    """
    d = len(sums)
    size = d if axes is None else axes.shape[1]

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros((size, size))
        for batch in batches:
            y = centred(matrix(plain(batch, "x"), d), n, sums)
            y = y if axes is None else y @ axes
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(size), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * size, pa.int32()),
            "row": pa.array(list(total), pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        row = np.sum(np.array(table.column("row").to_pylist()), axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([list(row)], pa.list_(pa.float64()))})

    partial = fit.mapInArrow(part, "i int, part int, row array<double>")
    rows = partial.groupBy("i").applyInArrow(added, "i int, row array<double>").collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)]) / n


# --- eigenvalues -------------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to a symmetric one, by reflections."""
    a, d = a.copy(), len(a)
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0:
            continue
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        w = rest @ v
        w -= v * (v @ w)
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Inertia: eigenvalues greater than ``shift``, the positive pivots of the shifted matrix."""
    diagonal, off = t
    tiny, pivot, count = 1e-300, 1.0, 0
    for k, value in enumerate(diagonal):
        pivot = value - shift - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def located(t: tuple[np.ndarray, np.ndarray], rank: int, low: float, high: float) -> float:
    """The eigenvalue of that rank, counted from the largest, by halving on inertia."""
    while high - low > 1e-15 * max(abs(low), abs(high), 1e-3):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(t, middle) >= rank else (low, middle)
    return (low + high) / 2


def interval(a: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): holds the ``wanted`` largest eigenvalues above zero and all that lie too near to part.

    ``a`` has trace 1; what rounding alone could make counts as zero.
    """
    t = tridiagonal(a)
    reach = np.abs(np.concatenate([[0], t[1]])) + np.abs(np.concatenate([t[1], [0]]))
    bottom, top = float((t[0] - reach).min()) - 1e-3, float((t[0] + reach).max()) + 1e-3
    zero = len(a) * 4e-16
    rank = above(t, zero)
    count = min(wanted, rank)
    while count < rank:
        here, after = (located(t, r, bottom, top) for r in (count, count + 1))
        if here - after > 1e-9 * here:
            return (here + after) / 2, top, count
        count += 1
    return zero, top, count


def contour(low: float, high: float, nodes: int = NODES) -> list[tuple[complex, complex]]:
    """Points and weights of Gauss-Legendre quadrature on the upper half of a circle over the interval."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    return [(complex(centre + radius * e), complex(radius * e * w / 2)) for e, w in zip(turn, weights)]


def projected(spark, a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the interval's eigenspace: one shifted solve a task, one per quadrature node."""
    nodes = [(i, z.real, z.imag, w.real, w.imag) for i, (z, w) in enumerate(contour(low, high))]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, zr, zi, wr, wi in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.linalg.solve(complex(zr, zi) * np.eye(len(a)) - a, block.astype(complex))
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "part": pa.array([(complex(wr, wi) * found).real.ravel()], pa.list_(pa.float64()))})

    points = spark.createDataFrame(nodes, "i int, zr double, zi double, wr double, wi double").repartition(len(nodes), "i")
    rows = points.mapInArrow(solve, "i int, part array<double>").collect()
    return sum(np.array(r.part) for r in sorted(rows, key=lambda r: r.i)).reshape(block.shape)


def ritz(a: np.ndarray, block: np.ndarray, low: float, high: float):
    """Rayleigh-Ritz on the block: all vectors, then values and residuals of those in the interval, largest first."""
    q, _ = np.linalg.qr(block)
    values, inner = np.linalg.eigh(q.T @ a @ q)
    vectors = q @ inner
    order = np.flatnonzero((values > low) & (values < high))[::-1]
    pairs = vectors[:, order]
    return vectors, values[order], pairs, np.linalg.norm(a @ pairs - pairs * values[order], axis=0)


def leading(spark, covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``wanted`` largest eigenvalues above zero and their unit vectors (as columns)."""
    trace = float(np.trace(covariance))
    d = len(covariance)
    if not d or trace <= 0:
        return np.empty(0), np.empty((d, 0))
    a = (covariance + covariance.T) / (2 * trace)
    low, high, count = interval(a, wanted)
    size = min(d, max(2 * count, count + 4))
    while True:
        block = np.random.default_rng(SEED).standard_normal((d, size))
        for _ in range(ROUNDS):
            block, values, pairs, rest = ritz(a, projected(spark, a, block, low, high), low, high)
            if len(values) == count and (rest <= TOLERANCE * d).all():
                break
        if len(values) == count:
            break
        if size == d:
            raise ArithmeticError(f"{len(values)} components found of {count} in the interval")
        size = min(d, 2 * size)
    pairs = pairs[:, :wanted]
    largest = np.abs(pairs).argmax(axis=0)
    return values[:wanted] * trace, pairs * np.where(pairs[largest, range(pairs.shape[1])] < 0, -1.0, 1.0)


# --- rows --------------------------------------------------------------------------------

def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per kept row and component: key, component, n, deviation, whitened, explained, identity_error."""
    schema = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    x = integers(df, key, vector).withColumn("key", F.col("key").cast("long"))
    lists = written(x.select("x").distinct(), "whitening-fit")
    d = length_of(lists)
    fit = lists.where(F.size("x") == d)
    if not d:
        return spark.createDataFrame([], schema)
    n, sums = column_sums(fit, d)
    covariance = products(fit, n, sums)
    values, axes = leading(spark, covariance, wanted)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    explained = values / np.trace(covariance)
    error = float(np.abs(products(fit, n, sums, scaled) - np.eye(k)).max())

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, keys = plain(batch, "x"), plain(batch, "key")
            rows = len(keys)
            same = np.diff(column.offsets.to_numpy()) == d
            vectors = matrix(column.filter(pa.array(same)), d)
            scores = np.full((rows, k), np.nan)
            scores[same] = centred(vectors, n, sums) @ scaled
            spread = np.full(rows, None, object)
            spread[same] = deviations(vectors, n, sums)
            yield pa.RecordBatch.from_pydict({
                "key": keys.take(pa.array(np.repeat(np.arange(rows), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                "n": pa.array([n] * (rows * k), pa.int64()),
                "deviation": pa.array(np.repeat(spread, k), pa.int64()),
                "whitened": pa.array(scores.ravel(), pa.float64(), from_pandas=True),
                "explained": pa.array(np.tile(explained, rows), pa.float64()),
                "identity_error": pa.array([error] * (rows * k), pa.float64())})

    return x.mapInArrow(score, schema)


def report(embeddings: DataFrame) -> DataFrame:
    return whitened(embeddings).withColumnRenamed("key", "vec_id")
