"""The index of vectors against exact recall: append, re-assignment, rerun batches, bounds, odd rows."""

import numpy as np
import pytest

from briefwell.operators import recall, vector_index

KIND = "id long, vector array<double>, note string"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(8, 12)) * 3
    # A third of the rows around one middle; some rows repeat a vector.
    rows = [(i, (middles[0 if i % 3 == 0 else i % 8] + rng.normal(size=12)).tolist(), "x") for i in range(600)]
    rows += [(600 + i, rows[i][1], None) for i in range(20)]
    rows += [(900, None, None), (901, [], None), (902, [0.0] * 12, None), (903, [1.0] * 5, None), (904, [float("nan")] * 12, None), (905, [None] + [1.0] * 11, None), (None, [1.0] * 12, None)]
    return spark.createDataFrame(rows, KIND)


def found(df):
    return {(r["query_id"], r["place"], r["id"], r["distance"]) for r in df.collect()}


def test_index_equals_exact_recall(spark, items, tmp_path):
    path = f"file://{tmp_path}/index"
    asked = items.filter("id % 25 = 0")
    first = items.filter("id % 4 <> 1")
    vector_index.build(first, path, cells=8)
    assert found(vector_index.search(asked, path, 4)) == found(recall.recall(asked, first, 4))
    for _ in range(2):  # a batch that runs again replaces itself
        vector_index.append(items.filter("id % 4 = 1"), path, 1)
    assert vector_index.postings(spark, path).count() == 620
    for limit in (None, 0.05, 0.3, 2.1):
        assert found(vector_index.search(asked, path, 4, max_distance=limit)) == found(recall.recall(asked, items, 4, limit))
    vector_index.reassign(spark, path, cells=12)
    assert vector_index.postings(spark, path).count() == 620
    assert found(vector_index.search(asked, path, 4, max_distance=0.3)) == found(recall.recall(asked, items, 4, 0.3))
    with pytest.raises(ValueError):
        vector_index.append(items, path, 0)


def test_a_bounded_search_leaves_cells_out(spark, items, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build(items, path, cells=8)
    read = []
    plain = vector_index.postings

    class Watched:
        def __init__(self, df):
            self.df = df

        def filter(self, cells):
            kept = self.df.filter(cells)
            read.append(kept.select("cell").distinct().count())
            return kept

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vector_index, "postings", lambda s, p: Watched(plain(s, p)))
        vector_index.search(items.filter("id = 3"), path, 3, max_distance=0.05).collect()
        vector_index.search(items.filter("id = 3"), path, 3, probes=1).collect()
    assert read[0] < 8 and read[1] == 1


def test_calibrated_probes_reach_the_target(spark, items, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build(items, path, cells=8)
    probes = vector_index.calibrate(spark, path, 5, target=0.95)
    assert 1 <= probes <= 8
    asked = items.filter("id % 7 = 0")
    rows = vector_index.measured(vector_index.search(asked, path, 5, probes), recall.recall(asked, items, 5)).collect()
    assert sum(r["n_found"] for r in rows) >= 0.9 * sum(r["n_exact"] for r in rows)


def test_empty_tables(spark, items, tmp_path):
    path = f"file://{tmp_path}/index"
    vector_index.build(items.limit(0), path)
    assert vector_index.search(items, path, 3).count() == 0 and vector_index.postings(spark, path).count() == 0
    assert vector_index.calibrate(spark, path, 3) == 1
    with pytest.raises(ValueError):
        vector_index.append(items, path, 1)
    vector_index.build(items.filter("id >= 900"), path)
    assert vector_index.search(items.limit(0), path, 3).count() == 0


def test_recall_of_the_registered_query(spark):
    from briefwell.plans.queries import QUERIES

    rows = QUERIES["recall_indexed"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n_found"] for r in rows) >= 0.9 * sum(r["n_exact"] for r in rows)
