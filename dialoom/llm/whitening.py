"""Whitened principal components of embeddings, from an exact grid of their entries.

Every entry ``c`` becomes the whole number ``floor(256 * c)``. Each distinct vector counts once:
these are the fit list, written as a table. Its sums are exact, its covariance is a distributed
sum of products of centred rows, and only matrices of the vectors' dimension reach the driver.
There, Householder reflections make the covariance tridiagonal, bisection on Sturm counts finds
the leading eigenvalues, inverse iteration their vectors (orthogonalised again within clusters of
close eigenvalues), and the reflections carry these back. The projection is broadcast and every
row is projected in one pass without an exchange.

Defined results: rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out. A
vector shorter than the longest one has zeros behind its end. Components with an eigenvalue of
nothing but rounding are not returned, so equal vectors, or a single one, give no rows. Equal
eigenvalues keep the order in which they are found. A deviation beyond a long is NULL. Repeated
rows are returned each; a NULL id stays. An empty table gives an empty result. Only the id and
vector columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.session import materialize

SCALE = 256
COMPONENTS = 4
#: Eigenvalues closer than this share of the largest form a cluster.
CLUSTER = 1e-3
LARGEST = (1 << 63) - 1


# The eigenvectors of a symmetric matrix, by parts.


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, side diagonal and the reflections (unit vectors) of the Householder reduction."""
    a = np.array(matrix, np.float64)
    n, side, reflections = len(a), np.zeros(max(len(a) - 1, 0)), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not x[1:].any():
            side[k] = x[0]
            reflections.append(None)
            continue
        side[k] = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= side[k]
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        p -= (x @ p) * x
        rest -= 2.0 * (np.outer(x, p) + np.outer(p, x))
        reflections.append(x)
    if n > 1:
        side[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), side, reflections


def sturm_count(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number, how many eigenvalues of the tridiagonal matrix lie below it."""
    least = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    q = diagonal[0] - at
    below = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], side, strict=True):
        q = np.where(np.abs(q) < least, -least, q)
        q = d - at - e * e / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, side: np.ndarray, count: int) -> np.ndarray:
    """The largest ``count`` eigenvalues, falling, by bisection to double precision."""
    n = len(diagonal)
    reach = np.abs(np.concatenate(([0.0], side))) + np.abs(np.concatenate((side, [0.0])))
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    high += np.abs(high) * 1e-15 + np.finfo(np.float64).tiny
    wanted = n - np.arange(count)  # the k-th largest: so many eigenvalues at most lie below it, less one
    for _ in range(1200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = sturm_count(diagonal, side, middle) < wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low


def _solve_shifted(diagonal: np.ndarray, side: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """``(T - shift I) y = b`` by elimination with row exchanges; pivots of zero become ``floor``."""
    n = len(diagonal)
    d, up, low = diagonal - shift, side.copy(), side.copy()
    up2, y = np.zeros(max(n - 2, 0)), b.copy()
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], low[k] = low[k], d[k]
            up[k], d[k + 1] = d[k + 1], up[k]
            if k < n - 2:
                up2[k], up[k + 1] = up[k + 1], 0.0
            y[k], y[k + 1] = y[k + 1], y[k]
        if d[k] == 0.0:
            d[k] = floor
        m = low[k] / d[k]
        d[k + 1] -= m * up[k]
        if k < n - 2:
            up[k + 1] -= m * up2[k]
        y[k + 1] -= m * y[k]
    for k in range(n - 1, -1, -1):
        if k < n - 1:
            y[k] -= up[k] * y[k + 1]
        if k < n - 2:
            y[k] -= up2[k] * y[k + 2]
        y[k] /= d[k] if abs(d[k]) > floor else np.copysign(floor, d[k])
    return y


def tridiagonal_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration."""
    n, draw = len(diagonal), np.random.default_rng(13)
    size = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), np.finfo(np.float64).tiny)
    eps = np.finfo(np.float64).eps
    found: list[np.ndarray] = []
    cluster, previous = 0, None  # the first vector of the present cluster; the shift before
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * abs(values[0]):
            cluster, previous = k, None
        # Equal eigenvalues get shifts a few roundings apart.
        shift = value if previous is None else min(value, previous - 4 * eps * size)
        previous, y = shift, draw.standard_normal(n)
        for _ in range(6):
            y = _solve_shifted(diagonal, side, shift, y / np.abs(y).max(), eps * size)
            for _ in range(2):
                for other in found[cluster:]:
                    y -= (other @ y) * other
            if not np.abs(y).max():
                y = draw.standard_normal(n)
        found.append(y / np.linalg.norm(y))
    return np.array(found).reshape(len(found), n).T


def principal(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues that are more than rounding, falling, and their vectors as columns."""
    n = len(matrix)
    if not n or not matrix.any():
        return np.zeros(0), np.zeros((n, 0))
    diagonal, side, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, side, min(count, n))
    values = values[values > 8 * n * np.finfo(np.float64).eps * max(values[0], 0.0)]
    vectors = tridiagonal_vectors(diagonal, side, values)
    for k in range(len(reflections) - 1, -1, -1):
        if (v := reflections[k]) is not None:
            vectors[k + 1 :] -= 2.0 * np.outer(v, v @ vectors[k + 1 :])
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(len(values))])


# Passes over the vectors.


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """One row per vector, with zeros behind the end of a shorter one."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of rows (dimension -1) and the exact sum of every dimension."""
        total, rows = [0] * dims, 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            rows += len(x)
            exact = len(x) and int(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 1 << 62
            part = x.sum(axis=0) if exact else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(dims)], pa.int32()), pa.array([Decimal(v) for v in (rows, *total)], pa.decimal128(38, 0))],
            ["dim", "total"],
        )

    return run


@dataclass
class Moments:
    rows: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` in doubles; whole parts are taken off before rounding where they fit."""
        whole = [s // self.rows for s in self.sums]
        rest = np.array([(s % self.rows) / self.rows for s in self.sums])
        if np.abs(x.astype(np.float64)).max(initial=0) < 1 << 61:
            return (x - np.array(whole, np.int64)).astype(np.float64) - rest
        return x.astype(np.float64) - (np.array(whole, np.float64) + rest)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of ``(n * x - S) ** 2``, exact."""
        reach = self.rows * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        small = reach * reach * max(x.shape[1], 1) < 1 << 62
        kind = np.int64 if small else object
        t = x.astype(kind) * self.rows - np.array(self.sums, kind)
        return [int(v) if v <= LARGEST else None for v in (t * t).sum(axis=1)] if x.shape[1] else [0] * len(x)


def _products(moments: Moments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Row by row, the sums of the products of centred entries."""
        dims = len(moments.sums)
        total = np.zeros((dims, dims))
        for batch in batches:
            x = moments.centred(_matrix(batch.column(0), dims))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["dim", "products"]
        )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per dimension: the tasks' rows added up."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, products in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[dim] = total.get(dim, 0.0) + np.frombuffer(products, np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["dim", "products"]
    )


@dataclass
class Model:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray  # dimension x component
    explained: np.ndarray
    identity_error: float = 0.0

    def parts(self) -> tuple:
        """Plain values for a broadcast, where a class of this package would travel by name."""
        return self.moments.rows, self.moments.sums, self.values, self.vectors, self.explained, self.identity_error

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ (self.vectors / np.sqrt(self.values))


def _model(rows: int, sums: list[int], *rest) -> Model:
    return Model(Moments(rows, sums), *rest)


def on_grid(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, x``: the usable vectors with their entries as whole numbers."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    unusable = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    usable = F.col("v").isNotNull() & ~F.exists("v", unusable)
    return rows.filter(usable).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


def fit(grid: DataFrame, count: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of ``on_grid``; None without any."""
    found = materialize(grid.select("x").distinct())
    sizes = found.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[1] is None:
        return None
    least, dims = sizes
    if least < dims:  # vectors that differ in zeros at their ends only are one
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
        found = materialize(found.select(filled.alias("x")).distinct())
    # From here on the driver holds a number, or a row of doubles, per dimension.
    totals = found.mapInArrow(_sums(dims), "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total"))
    total = {row["dim"]: int(row["total"]) for row in totals.collect()}
    moments = Moments(total[-1], [total[k] for k in range(dims)])
    rows = "dim int, products binary"
    products = found.mapInArrow(_products(moments), rows).repartition("dim").mapInArrow(_added, rows).collect()
    covariance = np.array([np.frombuffer(r["products"], np.float64) for r in sorted(products, key=lambda r: r["dim"])])
    covariance = covariance.reshape(dims, dims) / moments.rows
    values, vectors = principal((covariance + covariance.T) / 2, count)
    trace = float(np.trace(covariance))
    model = Model(moments, values, vectors, values / trace if trace else values)
    if len(values):
        shared = grid.sparkSession.sparkContext.broadcast(model.parts())

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent, total = _model(*shared.value), 0.0
            for batch in batches:
                w = sent.whiten(_matrix(batch.column(0), dims))
                total = total + w.T @ w
            flat = (total + np.zeros((len(values), len(values)))).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["cell", "total"])

        cells = found.mapInArrow(check, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
        seen = np.array([r["total"] for r in sorted(cells, key=lambda r: r["cell"])]).reshape(len(values), -1) / moments.rows
        model.identity_error = float(np.abs(seen - np.eye(len(values))).max())
    return model


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(grid: DataFrame, model: Model | None) -> DataFrame:
    """A row for every vector and component, in one pass."""
    spark = grid.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(*shared.value)
        dims, count = model.vectors.shape
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            size = len(x) * count
            deviation = pa.array(model.moments.deviations(x), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.moments.rows, np.int64)),
                    deviation.take(each),
                    pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(size, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return grid.mapInArrow(run, SCHEMA)


def digest(vectors: DataFrame) -> DataFrame:
    """The registered query: every usable vector's leading components."""
    grid = on_grid(vectors)
    return whiten(grid, fit(grid))
