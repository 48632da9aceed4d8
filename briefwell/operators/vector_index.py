"""An inverted-file index of vectors: cells by k-means, posting lists stored by cell, append, re-assignment, search.

Under a folder that the driver and all executors share lie a table ``made`` (generation, cells, width: one row for each
finished generation; readers take the last) and, for each generation, ``cells`` (cell, centre), ``postings`` (id, vector,
in folders by batch and cell) and ``radii`` (cell, radius by batch). One writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_per_group
from .recall import _blocks, _matrix, nearest
from .stored import stored

#: Components of all centres together, which the driver and each task hold (32 MB of doubles).
CENTRE_VALUES = 1 << 22
#: Added to angles, for rounding of distances to four places.
SLACK = 0.02


def _made(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """(generation, cells, width) of the last finished generation."""
    try:
        made = spark.read.schema("generation int, cells int, width int").parquet(f"{path}/made")
        row = made.orderBy(F.col("generation").desc()).first()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        row = None
    return tuple(row) if row else None


def _centres(spark: SparkSession, path: str, generation: int) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/generation={generation}/cells").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


def _unit_rows(items: DataFrame, width: int) -> DataFrame:
    """(id, unit vector) of the rows that can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _matrix(batch.column(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.FixedSizeListArray.from_arrays(units.ravel(), width).cast(pa.list_(pa.float64()))], ["id", "vector"])

    same = items.filter(F.col("id").isNotNull() & (F.size("vector") == width))
    return same.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "id long, vector array<double>")


def _fit(units: DataFrame, n: int, cells: int, sample: int, seed: int) -> np.ndarray:
    """Unit centres of k-means by cosine over about ``sample`` rows, told by a hash of their ids, so that reruns agree."""
    chosen = units if n <= sample else units.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=15).fit(chosen.select(array_to_vector("vector").alias("features")))
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.sqrt((centres * centres).sum(axis=1)), 1e-300)[:, None]


def _post(units: DataFrame, path: str, generation: int, batch: int, centres: np.ndarray) -> None:
    """Write rows to the posting lists of their nearest centres; a batch that is written again replaces itself."""
    spark = units.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = _matrix(batch.column(1))
            near = rows @ sent.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vector", "cell", "angle"])

    base = f"{path}/generation={generation}"
    # Files hold whole cells where cells are small; adaptive execution splits a hot cell by size.
    rows = units.mapInArrow(run, "id long, vector array<double>, cell int, angle double").hint("rebalance", "cell")
    rows.write.mode("overwrite").partitionBy("cell").parquet(f"{base}/postings/batch={batch}")
    posted = spark.read.schema("id long, vector array<double>, angle double, cell int").parquet(f"{base}/postings/batch={batch}")
    posted.groupBy("cell").agg(F.max("angle").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{base}/radii/batch={batch}")
    sent.destroy()


def _generation(items: DataFrame, path: str, cells: int, per_cell: int, seed: int) -> bool:
    """Fit, write and announce a new generation; an empty table makes none."""
    spark = items.sparkSession
    usable = items.filter(F.col("id").isNotNull()).groupBy(F.size("vector").alias("width")).count().filter("width > 0")
    most = usable.orderBy(F.col("count").desc(), "width").first()
    if most is None:
        return False
    width, n = int(most["width"]), int(most["count"])
    if cells * width > CENTRE_VALUES:
        raise ValueError(f"{cells} centres of {width} components are more than {CENTRE_VALUES} values")
    last = _made(spark, path)
    number = last[0] + 1 if last else 1
    units = _unit_rows(items, width)
    if units.isEmpty():
        return False
    centres = _fit(units, n, cells, cells * per_cell, seed)
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/generation={number}/cells")
    _post(units, path, number, 0, centres)
    spark.createDataFrame([(number, len(rows), width)], "generation int, cells int, width int").coalesce(1).write.mode("append").parquet(f"{path}/made")
    return True


def build(items: DataFrame, path: str, cells: int = 64, per_cell: int = 256, seed: int = 7) -> None:
    """Index all rows of ``items`` (id, vector) at ``path``.

    Centres are fitted on about ``cells * per_cell`` rows, a bounded sample; every row is posted. Vectors that are null,
    empty, zero, of another length than most or hold a null or non-finite component take no part.
    """
    _generation(items, path, cells, per_cell, seed)


def append(items: DataFrame, path: str, batch: int) -> None:
    """Post new rows to the cells that are there, as batch ``batch`` (1 or more); a batch that runs again replaces itself."""
    spark = items.sparkSession
    last = _made(spark, path)
    if last is None:
        raise ValueError(f"no index at {path}")
    if batch < 1:
        raise ValueError("batch 0 is the rows of the index itself")
    number, _, width = last
    _post(_unit_rows(items, width), path, number, batch, _centres(spark, path, number))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, cell) of all batches of the last generation; a filter on ``cell`` reads only those folders."""
    last = _made(spark, path)
    if last is None:
        return spark.createDataFrame([], "id long, vector array<double>, cell int")
    return spark.read.schema("id long, vector array<double>, batch int, cell int").parquet(f"{path}/generation={last[0]}/postings").select("id", "vector", "cell")


def reassign(spark: SparkSession, path: str, cells: int = 64, per_cell: int = 256, seed: int = 7) -> None:
    """Fit new centres over all that was posted and write the next generation; the last one stays for running readers."""
    _generation(postings(spark, path), path, cells, per_cell, seed)


def search(queries: DataFrame, path: str, k: int, probes: int | None = None, max_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance, place): the k nearest indexed items of each query (id, vector) but itself.

    With ``probes``, a query looks into the cells of its nearest centres only: results may lack items. Without, it looks
    into every cell that can hold an item within ``max_distance``: by the triangle inequality of angles a cell is left
    out if query and centre are further apart than the cell's radius and the angle of the distance together, so results
    are those of exact recall. Queries are sent to tasks in blocks of a fixed size; cells that no query of a block looks
    into are not read.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "query_id long, id long, distance double, place int")
    last = _made(spark, path)
    if last is None:
        return empty
    number, count, width = last
    centres = _centres(spark, path, number)
    radius = np.full(count, -np.inf)
    for row in spark.read.schema("cell int, radius double, batch int").parquet(f"{path}/generation={number}/radii").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[row["cell"]] = row["radius"]
    parts = None
    for ids, vectors in _blocks(queries.filter(F.size("vector") == width)):
        near = np.clip(vectors @ centres.T, -1, 1)
        if probes is not None:
            look = np.zeros(near.shape, bool)
            look[np.arange(len(ids))[:, None], np.argsort(-near, axis=1, kind="stable")[:, :probes]] = True
            look &= np.isfinite(radius)
        else:
            within = np.pi if max_distance is None else np.arccos(np.clip(1 - max_distance, -1, 1))
            look = np.arccos(near) <= radius + within + SLACK
        cells = np.flatnonzero(look.any(axis=0)).tolist()
        if not cells:
            continue
        sent = spark.sparkContext.broadcast((ids, vectors, look))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, vectors, look = sent.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches:
                _, there = _matrix(batch.column(1))
                own, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                for c in np.unique(cell):
                    rows, asks = np.flatnonzero(cell == c), np.flatnonzero(look[:, c])
                    nearest(best, asks, ids, vectors, own[rows], there[rows], k)
            found = [(int(ids[q]), i, d) for q, pairs in enumerate(best) for d, i in pairs]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found]) for c in range(3)], ["query_id", "id", "distance"])

        read = postings(spark, path).filter(F.col("cell").isin(cells))
        found = top_per_group(read.mapInArrow(run, "query_id long, id long, distance double"), ["query_id"], [F.col("distance"), F.col("id")], k)
        found = stored(found, "near")
        sent.destroy()
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return empty
    return parts if max_distance is None else parts.filter(F.col("distance") < max_distance)


def calibrate(spark: SparkSession, path: str, k: int, target: float = 0.95, asked: int = 256, seed: int = 11) -> int:
    """The fewest probes by which a share ``target`` of the k nearest items of ``asked`` indexed rows (told by hash) is found.

    The rows are a bounded sample and are compared with all rows of the index, so the figure holds for rows like them.
    """
    last = _made(spark, path)
    if last is None:
        return 1
    held = postings(spark, path)
    sample = held.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(asked)
    exact = search(sample, path, k)
    places = exact.select("query_id", "id").join(held.select("id", "cell"), "id").collect()
    ids, vectors = [], []
    for block_ids, block in _blocks(sample.select("id", "vector")):
        ids.extend(block_ids.tolist())
        vectors.append(block)
    if not places:
        return 1
    order = np.argsort(-(np.concatenate(vectors) @ _centres(spark, path, last[0]).T), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    row = {i: r for r, i in enumerate(ids)}
    needed = np.sort([rank[row[p["query_id"]], p["cell"]] + 1 for p in places])
    return int(needed[int(np.ceil(target * len(needed))) - 1])


def measured(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall): how many of a query's exact neighbours the index found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
