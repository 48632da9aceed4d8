"""Seen URLs by filters: the same as a plain anti-join, however the history was appended."""

from pyspark.sql import functions as F

from briefwell.functions.urls import url_hash
from briefwell.operators import dedup, seen


def urls_of(spark, first, last):
    return spark.createDataFrame([(k, f"https://h{k % 7}.example/{k}") for k in range(first, last)], "ord int, url string")


def test_filtered_equals_plain(spark, tmp_path):
    path, bits = str(tmp_path / "seen"), 1 << 8  # small filters, so that false hits occur
    for first, last in ((0, 2000), (2000, 2050), (1900, 4000)):
        seen.append_seen(urls_of(spark, first, last), path, bits=bits)
    rows = urls_of(spark, 3500, 6000).unionByName(spark.createDataFrame([(-1, None), (-2, "https://h0.example/0"), (-2, "https://h0.example/0")], "ord int, url string"))
    history = urls_of(spark, 0, 4000).select(url_hash(F.col("url")).alias("url_hash"))
    plain = sorted(r.ord for r in dedup.unseen(rows.filter("url is not null"), history).collect())
    got = sorted(r.ord for r in seen.unseen_by_filter(rows, path, bits=bits).collect())
    assert got == [-1, *plain] and plain == list(range(4000, 6000))
    filters = spark.read.parquet(f"{path}/filter")
    asked = rows.filter("url is not null").select(url_hash(F.col("url")).alias("url_hash")).distinct()
    hits = seen.possible_hits(asked, filters, bits)
    assert asked.join(history, "url_hash", "left_semi").join(hits, "url_hash", "left_anti").count() == 0  # none is missed
    stated = seen.false_hit_share(filters, bits).agg(F.avg("share")).first()[0]
    assert 0 < abs(hits.count() - 501) <= 3 * 2000 * stated + 10


def test_filters_of_usual_size_let_hardly_any_through(spark, tmp_path):
    path = str(tmp_path / "seen")
    seen.append_seen(urls_of(spark, 0, 3000), path)
    filters = spark.read.parquet(f"{path}/filter")
    asked = urls_of(spark, 10_000, 13_000).select(url_hash(F.col("url")).alias("url_hash"))
    assert seen.possible_hits(asked, filters).count() == 0 and seen.false_hit_share(filters).agg(F.max("share")).first()[0] < 1e-12


def test_no_history_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "seen")
    rows = urls_of(spark, 0, 5)
    assert seen.unseen_by_filter(rows, path).count() == 5
    seen.append_seen(rows.limit(0), path)
    assert seen.unseen_by_filter(rows, path).count() == 5
    seen.append_seen(rows, path)
    assert seen.unseen_by_filter(rows, path).count() == 0 and seen.unseen_by_filter(rows.limit(0), path).columns == ["ord", "url"]
