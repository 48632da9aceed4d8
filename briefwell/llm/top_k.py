"""Exact top-k search by inner product over integer vectors, with MaxScore.

A component is a term, its value a posting. Per shard, a query's terms get score bounds from the largest and smallest
value posted; terms in order of what they can still add are split at the point where the rest together cannot lift a
row over the k-th best score so far: those before are essential and are added up for all rows, the others are probed,
group by group, only for rows that are still competitive. Queries come in blocks of a fixed size, shards are runs of
rows, and each task keeps only k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

SHARD_ROWS = 8192
#: Components of all queries of one block.
BLOCK_VALUES = 1 << 20
PROBE = 8


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as double; null for a vector that is null or holds a null or non-finite component."""
    real = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(vector.isNotNull() & real, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")))


class Block:
    """Queries of one block and, in a task, their best rows so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, q: int, scores: np.ndarray, rows: np.ndarray) -> None:
        """Keep the k best of what is kept and (scores, rows): by score, then smaller id."""
        s, r = np.concatenate([self.best[q][0], scores]), np.concatenate([self.best[q][1], rows])
        order = np.lexsort((r, -s))[: self.k]
        self.best[q] = s[order], r[order]

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take a shard's rows into account."""
        if not len(ids):
            return
        limit = max(1.0, float(np.abs(vectors).max(initial=0))) * max(1.0, float(np.abs(self.vectors).max(initial=0))) * max(1, vectors.shape[1])
        if limit >= 2**63:
            raise OverflowError("components are so large that scores may not fit in 64 bits; use a smaller scale")
        kind = np.float64 if limit < 2**53 else np.int64
        postings = np.ascontiguousarray(vectors.T, dtype=kind)
        high, low = (postings.max(axis=1), postings.min(axis=1)) if len(postings) else (np.zeros(0, kind),) * 2
        for q, vector in enumerate(self.vectors.astype(kind)):
            self._search_one(q, vector, ids, postings, high, low)

    def _search_one(self, q: int, vector: np.ndarray, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        upper, lower = np.maximum(vector * high, vector * low), np.minimum(vector * high, vector * low)
        order = np.argsort(lower - upper, kind="stable")
        after = np.append(np.cumsum(upper[order][::-1])[::-1], 0)  # what terms from each place on can add at most
        own = ids == self.ids[q]
        if len(self.best[q][0]) < self.k:  # no threshold yet: score the first rows whole
            first = np.flatnonzero(~own)[: 16 * self.k]
            self.add(q, (vector @ postings[:, first]).astype(np.int64), ids[first])
            rows = np.setdiff1d(np.flatnonzero(~own), first, assume_unique=True)
        else:
            rows = np.flatnonzero(~own)
        if not len(rows):
            return
        least = self.best[q][0][-1] if len(self.best[q][0]) == self.k else None
        # Non-essential: terms that cannot lift a row to the threshold which has only the least value in each essential term.
        at = len(order)
        if least is not None:
            at = int(np.argmax(np.append(np.append(0, np.cumsum(lower[order]))[:-1] + after[:-1] < least, True)))
        essential = order[:at]
        partial = vector[essential] @ (postings[essential] if len(rows) == len(ids) else postings[np.ix_(essential, rows)]) if at else np.zeros(len(rows), postings.dtype)
        while True:
            if least is not None:
                competitive = partial + after[at] >= least
                rows, partial = rows[competitive], partial[competitive]
            if at == len(order) or not len(rows):
                break
            probed = order[at : at + PROBE]
            partial = partial + vector[probed] @ postings[np.ix_(probed, rows)]
            at += len(probed)
        self.add(q, partial.astype(np.int64), ids[rows])


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest integer inner products with every row but its own.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; a query meets rows of its own dimension. Fewer rows than k: all. No query: no rows. Of rows that share
    a query's id the one whose vector sorts first asks; each repeated candidate row counts. Scores that may pass 64 bits
    are an error.

    Vectors are quantised once, to a table. Queries come in blocks, each of which is answered and written before the
    next is read, so neither the driver nor a task holds more than one.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q")).filter(F.col("v").isNotNull() & F.col("id").isNotNull())
    whole = materialize(whole, "vectors")
    names = ["query_id", "id", "score"]
    parts = None
    for block in _blocks(whole.filter("q").groupBy("id").agg(F.min("v").alias("v"))):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            dims, (ids, matrix) = sent.value
            own = Block(ids, matrix, k)
            for shard in (batch.slice(i, SHARD_ROWS) for batch in batches for i in range(0, batch.num_rows, SHARD_ROWS)):
                width = np.asarray(shard.column(1).value_lengths())
                keep = np.flatnonzero(width == dims)
                values = np.asarray(shard.column(1).take(pa.array(keep)).flatten()).reshape(len(keep), dims)
                own.search(np.asarray(shard.column(0))[keep], values)
            for q, (scores, rows) in enumerate(own.best):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), ids[q])), pa.array(rows), pa.array(scores)], names)

        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id")))
        found = whole.select("id", "v").mapInArrow(run, "query_id long, id long, score long").withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)
        best = materialize(found.select("query_id", "rank", F.col("id").alias(id_col), "score"), "best")
        sent.destroy()
        parts = best if parts is None else parts.unionByName(best)
    if parts is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    return parts


def _blocks(queries: DataFrame) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of queries of one dimension, read piece by piece and never more than BLOCK_VALUES components at once."""
    held: dict[int, list] = {}
    for row in materialize(queries, "queries").toLocalIterator():
        dims = len(row[1])
        held.setdefault(dims, []).append(row)
        if len(held[dims]) * max(1, dims) >= BLOCK_VALUES:
            yield dims, _matrix(held.pop(dims), dims)
    for dims, rows in held.items():
        yield dims, _matrix(rows, dims)


def _matrix(rows: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), dims)
