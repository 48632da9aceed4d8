"""Sinks: history tables, snapshots, message and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip
from ..functions.urls import url_hash
from ..operators.dedup import first_by
from ..operators.history import insert_new


def append_history(articles: DataFrame, path: str, order: list[Column]) -> None:
    """Append the articles whose URL hash the table at ``path`` does not hold; a missing table is started."""
    spark = articles.sparkSession
    rows = first_by(articles.withColumn("url_hash", url_hash(F.col("url"))), F.col("url_hash"), order)
    try:
        known = spark.read.parquet(path)
        known.schema  # noqa: B018
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = None
    fresh = rows if known is None else insert_new(known, rows, "url_hash")
    fresh.write.mode("append").parquet(path)


def compact_snapshot(articles: DataFrame, drop: tuple[str, ...] = ("content", "html", "raw"), most: int = 320) -> DataFrame:
    """One JSON text a row: long text columns dropped, strings clipped, nulls left out."""
    kept = [c for c in articles.columns if c not in drop]
    kinds = dict(articles.dtypes)
    return articles.select(F.to_json(F.struct(*[clip(F.col(c), most).alias(c) if kinds[c] == "string" else F.col(c) for c in kept])).alias("value"))


def markdown_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a markdown table, with their order key ``line``; the two head lines come first."""
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line long, value string")
    body = rows.select((F.monotonically_increasing_id() + 2).alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))
    return head.unionByName(body)


def digest_messages(selected: DataFrame, lane: str, order: str) -> DataFrame:
    """One HTML message for each lane: a bold head and a numbered, linked line for each of its (few, already selected) items."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit('<a href="'), F.col("url"), F.lit('">'), escape(F.col("title")), F.lit("</a>"))
    grouped = selected.groupBy(lane).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("l")))).alias("x"))
    lines = F.transform("x", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["l"]))
    return grouped.select(lane, F.concat(F.lit("<b>"), escape(F.col(lane)), F.lit("</b>\n"), F.array_join(lines, "\n")).alias("message"))
