"""Landed RSS and Atom files as rows."""

from __future__ import annotations

from collections.abc import Iterator
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def item_fields(node: ElementTree.Element) -> dict[str, str]:
    """Title, url, published and summary of an item or entry; '' for what it lacks."""
    own: dict[str, str] = {}
    for x in node:
        value = x.get("href") if local_name(x.tag) == "link" and x.get("href") else (x.text or "").strip()
        own.setdefault(local_name(x.tag), value)
    return {"title": own.get("title", ""), "url": own.get("link", ""), "published": own.get("pubDate") or own.get("published") or own.get("updated") or "", "summary": own.get("description") or own.get("summary") or ""}


def _items(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(place, title, url, published, summary) of each item or entry."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return
    for place, node in enumerate(x for x in root.iter() if local_name(x.tag) in ("item", "entry")):
        yield place, *(item_fields(node)[c] for c in ("title", "url", "published", "summary"))


def _iso(text: str) -> str:
    try:
        return parsedate_to_datetime(text).isoformat()
    except (TypeError, ValueError):
        return text


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed, place, title, url, published, summary): one row an item; each file is one feed, parsed in the task that reads it."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed"), "value")

    @F.udf("array<struct<place:int,title:string,url:string,published:string,summary:string>>", useArrow=True)
    def parse(text: str) -> list:
        return [(p, t, u, _iso(d), s) for p, t, u, d, s in _items(text)]

    rows = files.select("feed", F.explode(parse("value")).alias("i")).select("feed", "i.*")
    return rows.withColumn("published", F.try_to_timestamp("published"))
