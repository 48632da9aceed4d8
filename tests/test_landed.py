"""The data source of landed files: kinds, errors, batch equals stream, restart from offsets."""

import os

import pytest

from briefwell.sources import feed, files, landed


def put(path, text, at):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (at, at))


def test_feeds_keep_what_comes_before_a_break(spark, tmp_path):
    item = "<item><title>t{0}</title><link>https://a.b/{0}</link><description>s</description></item>"
    put(tmp_path / "a.xml", "<rss><channel>" + "".join(item.format(i) for i in range(30)) + "</channel></rss>", 100)
    put(tmp_path / "b.xml", "<rss><channel>" + item.format(90) + "<item><title>cut", 101)
    put(tmp_path / "c.xml", "", 102)
    put(tmp_path / "_hidden.xml", "<x", 103)
    put(tmp_path / "atom.xml", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>e</title><link href="https://e"/><updated>2024-01-01</updated></entry></feed>', 104)
    rows = landed.read_landed(spark, str(tmp_path), "feed")
    got = {(r["fields"]["title"], r["fields"]["url"]) for r in landed.good(rows).collect()}
    assert got == {(f"t{i}", f"https://a.b/{i}") for i in [*range(30), 90]} | {("e", "https://e")}
    broken = landed.errors(rows).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["place"]) for r in broken) == [("b.xml", 1), ("c.xml", 0)] and all(r["error"] for r in broken)
    whole = feed.read_feeds(spark, str(tmp_path / "a.xml"))
    assert {r["title"] for r in whole.collect()} == {f"t{i}" for i in range(30)}


def test_blocks_equal_the_plain_reader(spark, tmp_path):
    text = "stray\nplatform: facebook\ngroup: G\ntitle: T\ntitle: U\ncontent: one\n two\tthree\n---\nplatform: other\ntitle: no\n---  \n\n---\nplatform: Manual\ncontent: only text"
    put(tmp_path / "s.txt", text, 100)
    got = landed.read_landed(spark, str(tmp_path), "blocks")
    columns = ["platform", "group", "title", "content", "source"]
    plain = files.read_social_blocks(spark, str(tmp_path)).select(columns)
    assert sorted(files.social_rows(got).select(columns).collect()) == sorted(plain.collect())
    assert [r["place"] for r in got.orderBy("place").collect()] == [0, 1, 2]


def test_json_lines_and_bad_bytes(spark, tmp_path):
    put(tmp_path / "x.json", b'{"a": 1}\n\n{"a": \n[1]\n{"a": "\xff"}\n{"b": "' + "ü".encode() * 50000 + b'"}', 100)
    rows = landed.read_landed(spark, str(tmp_path), "json")
    assert sorted(r["place"] for r in landed.good(rows).collect()) == [0, 5]
    assert sorted(r["place"] for r in landed.errors(rows).collect()) == [2, 3, 4]
    put(tmp_path / "y.txt", b"title: a\n---\ntitle: \xff\n", 100)
    blocks = landed.read_landed(spark, str(tmp_path / "y.txt").rsplit("/", 1)[0], "blocks").filter("file like '%y.txt'")
    assert landed.errors(blocks).count() == 1


def test_packing_and_empty_folders(spark, tmp_path):
    for i in range(6):
        put(tmp_path / f"{i}.json", '{"a": 1}\n' * 10, 100 + i)
    reader = landed.LandedReader({"path": str(tmp_path), "kind": "json", "target": "200"})
    assert [len(p.names) for p in reader.partitions()] == [2, 2, 2]
    assert landed.read_landed(spark, str(tmp_path), "json", target=1).count() == 60
    assert landed.read_landed(spark, str(tmp_path / "none"), "json").count() == 0
    with pytest.raises(ValueError):
        landed.LandedReader({"path": "x", "kind": "other"})


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    inbox, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    inbox.mkdir()

    def run():
        rows = landed.stream_landed(spark, str(inbox), "json", settle=0)
        query = rows.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
        query.awaitTermination(120)
        assert not query.isActive

    put(inbox / "a.json", '{"n": 1}\n{"n": 2}\n', 100)
    put(inbox / "b.json", '{"n": 3}\n{broken\n', 100)
    run()
    assert spark.read.parquet(out).count() == 4
    run()  # nothing new
    put(inbox / "aa.json", '{"n": 4}\n', 101)
    put(inbox / "c.json", '{"n": 5}\n', 4_000_000_000)  # not settled yet
    run()
    streamed = spark.read.parquet(out)
    assert streamed.count() == 5
    batch = landed.read_landed(spark, str(inbox), "json").filter("file not like '%/c.json'")
    key = lambda r: (r["file"], r["place"], str(r["fields"]), r["error"])
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))


def test_numbers_of_documents_are_no_dates(spark, tmp_path):
    """A document without a date of its own whose number has the form of one stays without; each keeps a URL of its own."""
    from briefwell.plans import intake
    from briefwell.plans.queries import QUERIES

    ids = [7, 13, 1313, 240110, 240111, 20240103, 1240109, -240110]
    spark.createDataFrame([(i, "text", "src5", "en", 300) for i in ids], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["ord"]: r for r in QUERIES["normalised_articles"](spark, str(tmp_path)).collect()}
    assert {i for i in ids if rows[i]["age_hours"] is None} == {i for i in ids if rows[i]["published_at_source"] == "unknown"} == {i for i in ids if i % 13 == 0}
    assert any(i % 13 == 0 and i > 200000 for i in ids)
    assert len({r["url"] for r in intake.raw_articles(spark, str(tmp_path)).collect()}) == len(ids)
