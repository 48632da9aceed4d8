"""Embedding whitening by cyclic Jacobi rotations of an exactly summed scatter matrix.

1. Entries become integers. One pass groups equal vectors (the fit list holds each once) and writes them out.
2. Sums over the fit list give an integer centre near the mean. Tasks multiply the centred vectors and emit one partial
   scatter matrix each, in whole numbers; Spark adds them. With the sums this is n^2 times the covariance, exactly.
3. The driver holds one dimension-by-dimension matrix, whatever the number of rows, and rotates it until all entries off
   the diagonal vanish beside the two diagonal entries they belong to, so that small eigenvalues keep their digits.
4. The sorted eigenvectors over the roots of their eigenvalues are sent to all tasks, which whiten every row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

#: Products are taken in floating point only where every partial sum stays a whole number below this.
WHOLE = 1 << 53
#: Entries must stay whole numbers in a double, and n times an entry in 128 bits.
MOST_ENTRY = float(1 << 52)
SWEEPS = 60


def whole_entries(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * entry) + offset of each entry as long; null for vectors that are null, empty, or hold null, non-finite or over-large entries."""
    each = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(each, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(MOST_ENTRY / scale)))
    return F.when(good & (F.size(vector) > 0), F.transform(each, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset)))


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A rotation is skipped once its entry is below the rounding of the two diagonal entries, which is the criterion that
    keeps small eigenvalues of positive definite matrices accurate. Each vector's entry of largest size is positive.
    """
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    v = np.eye(d)
    tiny = np.finfo(np.float64).eps / 4
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if off == 0 or abs(off) <= tiny * math.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1, theta) / (abs(theta) + math.hypot(theta, 1)) if theta else 1.0
                c = 1 / math.hypot(t, 1)
                s = t * c
                low, high = a[p, p] - t * off, a[q, q] + t * off
                rows = a[[p, q]]
                new_p, new_q = c * rows[0] - s * rows[1], s * rows[0] + c * rows[1]
                a[p], a[:, p], a[q], a[:, q] = new_p, new_p, new_q, new_q
                a[p, p], a[q, q], a[p, q], a[q, p] = low, high, 0.0, 0.0
                left, right = v[:, p].copy(), v[:, q].copy()
                v[:, p], v[:, q] = c * left - s * right, s * left + c * right
        if not turned:
            break
    values = np.diagonal(a).copy()
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(d)]) if d else np.ones(0)
    return values[order], v * signs


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def scatter_of(z: np.ndarray) -> np.ndarray:
    """Sum of the outer products of integer rows, in whole numbers (objects where 64 bits might not hold them)."""
    top = int(np.abs(z).max()) if z.size else 0
    if top * top * len(z) < WHOLE:
        return (z.astype(np.float64).T @ z.astype(np.float64)).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def _sums(rows: DataFrame, run, d: int) -> np.ndarray:
    """Adds up what ``run`` makes of each batch of vectors: (k, value) partial sums of a task, the rest by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = run(_vectors(batch.column(0), d)).astype(object)
            total = part if total is None else total + part
        if total is not None:
            values = [str(x) for x in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["k", "value"])

    found = rows.mapInArrow(partial, "k int, value string").groupBy("k").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out = {k: int(x) for k, x in found.collect()}  # one row for each entry of a matrix, whatever the number of vectors
    return np.array([out[k] for k in range(len(out))], dtype=object)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries (or entries beyond 2^52 / scale) take no part;
    where lengths differ, neither do vectors of another length than most have (of equal counts, the longer). Equal vectors
    count once in the fit and each gets its rows; so do rows that share an id or have none. ``deviation`` is null where it
    passes 64 bits, ``whitened`` where an eigenvalue is zero up to rounding (no spread to divide by); such components are
    left out of identity_error, which is measured over the fit list. No usable vector: no row.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("id"), whole_entries(F.col(vector_col), scale, offset).alias("x")).filter(F.col("x").isNotNull())
    fit = materialize(rows.select("x").distinct(), "fit-list")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows, fit = rows.filter(F.size("x") == d), fit.filter(F.size("x") == d)
    n = fit.count()
    first = _sums(fit, lambda x: x.astype(object).sum(axis=0) if np.abs(x).max() * len(x) >= WHOLE else x.sum(axis=0), d)
    centre = np.array([(2 * s + n) // (2 * n) for s in first], dtype=np.int64)
    rest = np.array([int(s) - n * int(c) for s, c in zip(first, centre)], dtype=object)  # sums of the centred entries
    upper = np.triu_indices(d)
    sums = _sums(fit, lambda x: scatter_of(x - centre)[upper], d)
    whole = np.zeros((d, d), dtype=object)
    whole[upper] = sums
    whole = whole + np.triu(whole, 1).T
    cov = np.array([[float(Fraction(n * whole[i, j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    trace = float(sum(Fraction(n * whole[i, i] - rest[i] * rest[i], n * n) for i in range(d)))
    values, basis = jacobi(cov)
    k = min(components, d)
    top = max(float(values[0]), 0.0)
    spread = [float(e) if e > d * np.finfo(np.float64).eps * top else None for e in values[:k]]
    turn = basis[:, :k] / np.sqrt([e or 1.0 for e in spread])
    mean_rest = np.array([float(Fraction(int(r), n)) for r in rest])

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - centre - mean_rest) @ turn

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k + 1, k)), 0
        for batch in batches:
            w = whitened(_vectors(batch.column(0), d))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
            count += len(w)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], ["k", "value"])

    parts = {i: x for i, x in fit.mapInArrow(products, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()}  # 17 x 16 rows
    both = np.array([parts[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / n
    used = [i for i in range(k) if spread[i] is not None]
    covariance = (both[:k] - np.outer(both[k], both[k]))[np.ix_(used, used)]
    error = float(np.abs(covariance - np.eye(len(used))).max()) if used else 0.0
    explained = [float(max(e, 0.0)) / trace if trace else 0.0 for e in values[:k]]
    numbers, short_rest = pa.array(range(1, k + 1), pa.int32()), [int(r) for r in rest]

    def deviations(x: np.ndarray) -> list[int | None]:
        z = x - centre
        top = n * int(np.abs(z).max()) + max(map(abs, short_rest))
        u = z * n - np.array(short_rest, dtype=np.int64) if top * top * d < 1 << 63 else z.astype(object) * n - np.array(short_rest, dtype=object)
        return [int(s) if s < 1 << 63 else None for s in (u * u).sum(axis=1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _vectors(batch.column(1), d)
            w = whitened(x)
            empty = np.tile([e is None for e in spread], m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    numbers.take(pa.array(np.tile(np.arange(k), m))),
                    pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel(), mask=empty),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    discard(fit)
    return rows.select("id", "x").mapInArrow(run, schema.replace(id_col, "id", 1)).withColumnRenamed("id", id_col)
