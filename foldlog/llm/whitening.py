"""Embedding whitening: distributed centred covariance, eigenvectors by bisection and inverse iteration, projection of every row.

Spark adds up whatever grows with the rows; the driver gets one d x d matrix (8 MB for 1,024 dimensions) and solves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Partial matrices are added so many at a time, level by level; a task works on so many entries of vectors at once.
FAN_IN, ENTRIES = 32, 1 << 20
#: Eigenvalues up to this share of the largest, times the dimensions, are rounding; components of them can't be scaled to one.
ROUNDING = 4 * np.finfo(float).eps
_LIMIT = 1 << 62


# Symmetric eigenproblem on the driver


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of H v H for H the product of Householder reflections, and their unit vectors (one a column)."""
    a, d, mirrors = v.astype(float).copy(), len(v), []
    for i in range(d - 2):
        x = a[i + 1 :, i]
        size, u = np.linalg.norm(x), x.copy()
        if size == abs(x[0]):
            mirrors.append(np.zeros(d - i - 1))
            continue
        end = -math.copysign(size, x[0])
        u[0] -= end
        length = np.linalg.norm(u)
        u /= length
        mirrors.append(u)
        rest = a[i + 1 :, i + 1 :]
        p = rest @ u
        q = p - u * (u @ p)
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[i + 1 :, i] = a[i, i + 1 :] = 0
        a[i + 1, i] = a[i, i + 1] = end
    return a.diagonal().copy(), a.diagonal(1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of T - shift."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off**2, initial=0)))
    count, pivot = np.zeros(len(shifts), int), np.ones(len(shifts))
    squares = np.concatenate([[0.0], off**2])
    for t, s in zip(diagonal, squares, strict=True):
        pivot = t - shifts - s / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bounds are neighbouring numbers or rounding can't tell more."""
    d = len(diagonal)
    reach = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    lo, hi = np.full(k, np.min(diagonal - reach)), np.full(k, np.max(diagonal + reach))
    span = max(abs(lo[0]), abs(hi[0]), np.finfo(float).tiny)
    lo, hi = lo - 1e-12 * span, hi + 1e-12 * span
    wanted = d - np.arange(k)  # the j-th largest has d - j eigenvalues at or below it
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= np.finfo(float).eps * span / 8)):
            break
        below = sturm_counts(diagonal, off, mid) >= wanted
        lo, hi = np.where(below, lo, mid), np.where(below, mid, hi)
    return (lo + hi) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """T - shift as rows swapped where the lower one has the larger pivot; main, first and second upper diagonal, multipliers, swaps."""
    d = len(diagonal)
    main, up, far = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    times, swaps, low = np.zeros(d), np.zeros(d, bool), np.append(off, 0.0)
    least = np.finfo(float).eps * max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0), np.finfo(float).tiny)
    for i in range(d - 1):
        if abs(low[i]) > abs(main[i]):
            swaps[i] = True
            main[i], below = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            if i + 2 < d:
                far[i], up[i + 1] = up[i + 1], 0.0
        else:
            below = low[i]
        main[i] = main[i] if main[i] else least
        times[i] = below / main[i]
        main[i + 1] -= times[i] * up[i]
        if i + 2 < d:
            up[i + 1] -= times[i] * far[i]
    main[d - 1] = main[d - 1] if abs(main[d - 1]) > least else least
    return main, up, far, times, swaps


def _solved(factors: tuple, b: np.ndarray) -> np.ndarray:
    main, up, far, times, swaps = factors
    x, d = b.copy(), len(b)
    for i in range(d - 1):
        if swaps[i]:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= times[i] * x[i]
    for i in range(d - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < d else 0) - (far[i] * x[i + 2] if i + 2 < d else 0)
        x[i] = rest / main[i]
        if abs(x[i]) > 1e100:  # only the direction counts
            x /= abs(x[i])
    return x


def leading_eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix by inverse iteration.

    Vectors of a cluster (eigenvalues closer than a thousandth of the matrix's norm) are made orthogonal to each other at every step;
    equal eigenvalues get shifts a rounding apart, so that their systems differ.
    """
    d, rng = len(diagonal), np.random.default_rng(7)
    norm = max(float(np.max(np.abs(diagonal), initial=0) + 2 * np.max(np.abs(off), initial=0)), np.finfo(float).tiny)
    out, first, shift = np.zeros((d, len(values))), 0, math.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        shift = min(value, shift - 4 * np.finfo(float).eps * norm) if j > first else value
        factors = _factors(diagonal, off, shift)
        x = rng.standard_normal(d)
        for _ in range(8):
            before = x
            x = _solved(factors, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                x = x - out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
            if abs(abs(x @ before) - 1) < 1e-15:
                break
        out[:, j] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix of covariances, k at most.

    Components whose eigenvalue is rounding (ROUNDING) are left out: a matrix of rank r has r components.
    """
    size = float(np.max(np.abs(v), initial=0))
    if not size:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, mirrors = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > ROUNDING * len(v) * max(values[0], 0)]
    vectors = leading_eigenvectors(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        u = mirrors[i]
        vectors[i + 1 :] -= 2 * np.outer(u, u @ vectors[i + 1 :])
    return values * size, vectors


# Sums over rows


@dataclass(frozen=True)
class Whitening:
    """What every row needs: fitted vectors n, exact sums by dimension, the largest |x|, components (columns), eigenvalues, share explained."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they can't overflow, else Python's integers."""
        wide = self.n * self.largest + max(map(abs, self.sums), default=0) >= _LIMIT
        kind = object if wide else np.int64
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(float) / self.n @ self.components / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and x (array of long) of the rows whose vector holds only finite numbers."""
    v = F.col(f"`{vector}`")
    scaled = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    # a number too large for x as a long can't be whitened exactly
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float(_LIMIT // SCALE // 2))))
    own = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").alias("key"), F.transform(scaled, lambda c: c + SHIFT).alias("x"))
    sizes = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()
    return own.where(F.size("x") == (sizes["d"] or 0)) if sizes["d"] is not None else own


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices of ENTRIES entries at most, and their vectors as rows."""
    for batch in it:
        if batch.num_rows:
            d = max(1, len(batch.column("x")[0]))
            step = max(1, ENTRIES // d)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _added(partial: DataFrame, parts: int) -> DataFrame:
    """Rows (part, i, row) added up to one row for each i, FAN_IN parts at a time and in order, so that runs agree."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, out = None, None, []
        for batch in it:
            rows = batch.column("row").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else []
            for at, row in zip(zip(batch.column("part").to_pylist(), batch.column("i").to_pylist(), strict=True), rows, strict=True):
                if at != now:
                    out += [(*now, total)] if now else []
                    now, total = at, row.copy()
                else:
                    total += row
        out += [(*now, total)] if now else []
        yield pa.RecordBatch.from_pydict({"part": pa.array([x[0] for x in out], pa.int64()), "i": pa.array([x[1] for x in out], pa.int64()), "row": pa.array([x[2] for x in out], pa.list_(pa.float64()))})

    while parts > 1:
        level = partial.withColumn("source", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN))
        partial = level.repartition("part", "i").sortWithinPartitions("part", "i", "source").mapInArrow(add, "part long, i long, row array<double>")
        parts = math.ceil(parts / FAN_IN)
    return partial


def _summed(fit: DataFrame, columns: int, rows_of) -> np.ndarray:
    """rows_of(x) (a matrix of that many columns for a block of vectors), added up over all vectors of fit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in _blocks(it):
            m = rows_of(x)
            total = m if total is None else total + m
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(total), pa.int64()), "i": pa.array(range(len(total)), pa.int64()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    partial = fit.mapInArrow(run, "part long, i long, row array<double>")
    rows = _added(partial, fit.rdd.getNumPartitions()).select("i", "row").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]).reshape(-1, columns)


def exact_sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, their sums by dimension and the largest |x|. Halves of 32 bits are added, so that nothing overflows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, most = 0, None, None, None
        for _, x in _blocks(it):
            h, l, m = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.abs(x).max(0)
            n, high, low, most = n + len(x), h if high is None else high + h, l if low is None else low + l, m if most is None else np.maximum(most, m)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(high)), pa.int64()), "n": pa.array([n] * len(high), pa.int64()), "high": pa.array(high), "low": pa.array(low), "most": pa.array(most)})

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.mapInArrow(run, "i long, n long, high long, low long, most long").groupBy("i").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.max("most").alias("most")).collect()
    rows = sorted(rows, key=lambda r: r["i"])
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in rows]
    return (rows[0]["n"] if rows else 0), sums, max((r["most"] for r in rows), default=0)


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of some distinct vectors x: sums, centred covariance, components, then how far whitened vectors are from unit covariance."""
    n, sums, largest = exact_sums(fit)
    d = len(sums)
    model = Whitening(n, sums, largest, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    if not d:
        return model

    def products(x: np.ndarray) -> np.ndarray:
        c = model.centred(x).astype(float) / n
        return c.T @ c

    v = _summed(fit, d, products) / n
    values, vectors = leading_components((v + v.T) / 2, components)
    model = Whitening(n, sums, largest, vectors, values, values / np.trace(v) if len(values) else values)
    k = len(values)
    if not k:
        return model
    mean = _summed(fit, k, lambda x: model.projected(x).sum(0, keepdims=True))[0] / n

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = model.projected(x) - mean
        return w.T @ w

    error = np.abs(_summed(fit, k, whitened_products) / n - np.eye(k)).max()
    return Whitening(n, sums, largest, vectors, values, model.explained, float(error))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (1 to components), n, deviation, whitened, explained and identity_error of each row.

    The model is fitted on all distinct vectors and goes to the tasks whole: components times dimensions numbers.
    Rows stay out whose vector is null or holds null, non-finite or over-long entries (2**55 and more), and those whose vector
    has another length than most (of equal counts, than the longest). Repeated rows and rows without key come back like others.
    Components without variance are left out: no rows for an empty table, or for one distinct vector. Other columns don't matter.
    deviation is null where it is beyond a long.
    """
    own = written(whole_vectors(rows, key, vector), "whole-vectors")
    model = fit_whitening(written(own.select("x").distinct(), "whitening-fit"), components)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for part, x in _blocks(it) if k else ():
            c = m.centred(x)
            if x.shape[1] * (m.n * m.largest + max(map(abs, m.sums))) ** 2 >= _LIMIT:
                c = c.astype(object)
            far = [int(s) if s < 1 << 63 else None for s in (c * c).sum(1)]
            size = part.num_rows
            yield pa.RecordBatch.from_arrays([
                part.column("key").take(pa.array(np.repeat(np.arange(size), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, m.n)), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(size), k))), pa.array(m.projected(x).ravel()),
                pa.array(np.tile(m.explained, size)), pa.array(np.full(size * k, m.identity_error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = own.schema["key"].dataType.simpleString()
    out = own.mapInArrow(run, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of embeddings and component up to 16; see whiten for the vectors that are left out."""
    return whiten(table(spark, sf_dir, "embeddings"))
