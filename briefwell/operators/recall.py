"""Vector recall: nearest items by cosine distance, then a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_per_group
from .stored import stored

#: Components of the queries that tasks are sent at once.
BLOCK_VALUES = 1 << 21
#: Distances that a task holds at once.
TILE_VALUES = 1 << 20
#: Queries that meet a batch's rows at once.
QUERIES = 1024


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be compared (not null, no null or non-finite component, not all 0) and their unit vectors."""
    widths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(widths.max(initial=0))
    whole = np.full((len(column), width), np.nan)
    for k in np.flatnonzero(widths == width) if width else []:
        whole[k] = column[int(k)].values.to_numpy(zero_copy_only=False)
    norms = np.sqrt((whole * whole).sum(axis=1))
    good = np.flatnonzero(np.isfinite(norms) & (norms > 0)) if width else np.zeros(0, np.int64)
    return good, whole[good] / norms[good, None]


def nearer(best: list[tuple[float, int]], distance: np.ndarray, own: np.ndarray, asked: int, k: int) -> list[tuple[float, int]]:
    """The k nearest (distance, id) of those held and a batch's, the asked item itself left out."""
    bound = best[-1][0] if len(best) == k else np.inf
    near = np.flatnonzero((distance <= bound) & (own != asked))
    if len(near) > k:
        near = near[np.lexsort((own[near], distance[near]))[:k]]
    return sorted(best + list(zip(distance[near].tolist(), own[near].tolist())))[:k]


def nearest(best: list[list[tuple[float, int]]], asks: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, there: np.ndarray, k: int) -> None:
    """Put what is near of a batch (``own`` ids, ``there`` vectors) among the best of the queries ``asks``.

    Distances are worked out for some rows and queries at a time, so that a task's memory does not grow with the queries.
    """
    for q0 in range(0, len(asks), QUERIES):
        some = asks[q0 : q0 + QUERIES]
        rows = max(1, TILE_VALUES // len(some))
        for r0 in range(0, len(own), rows):
            distance = there[r0 : r0 + rows] @ vectors[some].T
            np.subtract(1, distance, out=distance)
            np.round(distance, 4, out=distance)
            distance += 0.0
            bound = np.array([best[q][-1][0] if len(best[q]) == k else np.inf for q in some.tolist()])
            for j in np.flatnonzero((distance.min(axis=0) <= bound)).tolist():
                q = int(some[j])
                best[q] = nearer(best[q], distance[:, j], own[r0 : r0 + rows], ids[q], k)


def recall(queries: DataFrame, items: DataFrame, k: int, max_distance: float | None = None) -> DataFrame:
    """(query_id, place, id, distance): the k nearest items of each query but itself, then those within ``max_distance``.

    Both frames: (id, vector), vectors of one length. Queries are sent to the items' tasks in blocks of a fixed size, each
    answered and written before the next; a task multiplies batches of items by the block and keeps k items a query, so
    only those are shuffled. Vectors that are null, empty, zero or hold a null or non-finite component take no part. Ties by distance
    (rounded to four places) go to the smaller id.
    """
    spark = queries.sparkSession
    parts = None
    for ids, vectors in _blocks(queries):
        sent = spark.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                rows, there = _matrix(batch.column(1))
                if not len(rows) or there.shape[1] != vectors.shape[1]:
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)[rows]
                nearest(best, np.arange(len(ids)), ids, vectors, own, there, k)
            found = [(int(ids[q]), i, d) for q, pairs in enumerate(best) for d, i in pairs]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found]) for c in range(3)], ["query_id", "id", "distance"])

        near = top_per_group(items.filter("id IS NOT NULL").select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, distance double"), ["query_id"], [F.col("distance"), F.col("id")], k)
        near = stored(near, "near")
        sent.destroy()
        parts = near if parts is None else parts.unionByName(near)
    if parts is None:
        return spark.createDataFrame([], "query_id long, id long, distance double, place int")
    return parts if max_distance is None else parts.filter(F.col("distance") < max_distance)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and unit vectors, read piece by piece."""
    held: list = []
    for row in queries.select(F.col("id").cast("long"), "vector").toLocalIterator():
        if row[0] is not None and row[1]:
            held.append(row)
        if held and len(held) * len(held[0][1]) >= BLOCK_VALUES:
            yield _units(held)
            held = []
    if held:
        yield _units(held)


def _units(rows: list) -> tuple[np.ndarray, np.ndarray]:
    good, vectors = _matrix(pa.array([r[1] for r in rows], pa.list_(pa.float64())))
    return np.array([rows[k][0] for k in good.tolist()], np.int64), vectors
