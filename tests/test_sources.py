"""Readers, sinks and streams over small files."""

from pyspark.sql import functions as F

from briefwell.sources import feed, files, sinks
from briefwell.streaming import state, windows


def test_watchlist(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# seeds\nrepo:a/b\nRepo:A/B\nhttps://x.y/z\ntopic: agents: planning\n\n")
    got = {(r.kind, r.term) for r in files.read_watchlist(spark, str(tmp_path)).collect()}
    assert got == {("repo", "a/b"), ("url", "https://x.y/z"), ("topic", "agents: planning")}


def test_social_blocks(spark, tmp_path):
    (tmp_path / "s.txt").write_text("platform: facebook\ngroup: G\ntitle: T\ncontent: one\n two\n---\nplatform: other\ntitle: no\n---\nplatform: manual\ncontent: only text\n")
    rows = {r.platform: r for r in files.read_social_blocks(spark, str(tmp_path)).collect()}
    assert set(rows) == {"facebook", "manual"} and rows["facebook"].content == "one two" and rows["manual"].title == "only text"


def test_feeds(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><link>https://a.b/{i}</link><pubDate>Tue, 30 Jan 2024 0{i % 10}:00:00 +0000</pubDate></item>" for i in range(20))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}<item><title>undated</title></item></channel></rss>")
    (tmp_path / "bad.xml").write_text("<rss>")
    rows = feed.read_feeds(spark, str(tmp_path))
    assert rows.count() == 21
    assert files.feed_items(rows, "2024-01-31 00:00:00").count() == 12
    assert files.feed_items(rows, "2024-03-31 00:00:00", per_feed=50).count() == 1
    assert files.feed_items(rows, "2024-01-31 00:00:00", blocked=("a.b",)).count() == 0


def test_json_rows(spark):
    hits = spark.read.json(spark.createDataFrame([('{"title":"A","points":90,"created_at":"2024-01-30T12:00:00Z","num_comments":3,"objectID":"7"}',), ('{"title":"B","url":"https://b.c","points":40,"created_at":"2024-01-30T12:00:00Z","num_comments":1,"objectID":"8"}',)], "v string").rdd.map(lambda r: r.v))
    rows = files.hacker_news(hits, "2024-01-31 00:00:00").collect()
    assert [(r.title, r.url, r.community_signal_strength) for r in rows] == [("A", "https://news.ycombinator.com/item?id=7", 4)]
    repos = spark.createDataFrame([("a/b", "an agent", ["x"], "https://g/a/b", "2024-01-01", {"login": "a"}, 5), ("bad", "agent", [], "u", "2024", {"login": "z"}, 1)], "full_name string, description string, topics array<string>, html_url string, pushed_at string, owner struct<login:string>, stargazers_count int")
    kept = files.repositories(repos, ("agent",), from_search=True)
    assert [r.github_full_name for r in kept.collect()] == ["a/b"]
    releases = files.releases(spark.createDataFrame([("a/b", "v1", "", "u1", "2024-01-02", "x"), ("a/b", "v2", "Two", "u2", "2024-01-03", "y")], "repo_full_name string, tag_name string, name string, html_url string, published_at string, body string"))
    assert files.repo_with_release(kept, releases).first()["release_title"] == "a/b — Two"


def test_history_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([("https://a", "A", 1), ("https://a", "A2", 2), ("https://b", "B", 3)], "url string, title string, ord int")
    path = str(tmp_path / "history")
    for _ in range(2):
        sinks.append_history(rows, path, [F.col("ord")])
    assert sorted(r.title for r in spark.read.parquet(path).collect()) == ["A", "B"]


def test_texts_out(spark):
    rows = spark.createDataFrame([("Product", 1, "https://a", "x < y & z", None)], "lane string, ord int, url string, title string, content string")
    assert sinks.digest_messages(rows, "lane", "ord").first()["message"] == '<b>Product</b>\n1. <a href="https://a">x &lt; y &amp; z</a>'
    assert "content" not in sinks.compact_snapshot(rows).first()["value"]
    assert sinks.markdown_table(rows, ["lane", "ord"]).orderBy("line").collect()[2]["value"] == "| Product | 1 |"


def test_feedback_stream_is_idempotent(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    entries = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "update_id long, text string")
    entries.coalesce(1).write.json(str(source))
    for k in range(2):  # a second stream with a checkpoint of its own sees all rows again
        stream = spark.readStream.schema(entries.schema).json(str(source))
        state.sync_feedback(stream, table, str(tmp_path / f"checkpoint{k}")).awaitTermination()
    assert sorted(r.update_id for r in state.feedback_entries(spark, table).collect()) == [1, 2]


def test_source_history_stream_goes_on_under_a_new_checkpoint(spark, tmp_path):
    from briefwell.operators.history import COUNTS

    counts = ", ".join(f"{c} int" for c in COUNTS)
    rows = spark.createDataFrame([("s", *[k + 1 for k in range(len(COUNTS))], "2024-01-01"), ("t", *[1] * len(COUNTS), "")], f"source_key string, {counts}, last_selected_at string")
    source, table = tmp_path / "in", str(tmp_path / "table")
    rows.coalesce(1).write.json(str(source))
    run = lambda name: state.keep_source_history(spark.readStream.schema(rows.schema).json(str(source)), table, str(tmp_path / name)).awaitTermination()
    for name, times in (("c1", 1), ("c1", 1), ("c2", 2)):  # the second run of c1 has no new files
        run(name)
        got = {r.source_key: r for r in state.newest_source_history(spark, table).collect()}
        assert got["s"].skipped_weak == 10 * times and got["t"].runs_seen == times and got["s"].last_selected_at == "2024-01-01"
    assert state.newest_source_history(spark, str(tmp_path / "none")) is None


def test_windows_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp")).select("at", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = windows.tumbling(events, "at", "6 hours", ["event_type"]).count()
    stream = windows.with_watermark(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "at")
    query = windows.tumbling(stream, "at", "6 hours", ["event_type"]).count().writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["window"]["start"], r["event_type"], r["count"])
    assert sorted(map(key, spark.table("tumbling").collect())) == sorted(map(key, batch.collect()))
