"""Seen URLs at unbounded history: hashes by range, with a Bloom filter a range, so that only possible hits meet the history.

A filter is a set of bitmaps of 32,768 bits, one row each. Every append writes the bitmaps of its own hashes; bitwise or merges
what several appends wrote. Articles look their bits up by joining bitmaps, which are few beside the hashes; only those with all
bits set are joined to the history, of whose folders only their ranges are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_hash

#: Hash ranges (by the first byte), and bits that each hash sets.
RANGES, PROBES = 64, 4
#: Bits of a range's filter: at 10 bits a hash, 64 ranges hold 26 million hashes with 1.2 % false hits.
RANGE_BITS = 1 << 22


def _range(h: Column) -> Column:
    return F.floor(F.conv(F.substring(h, 1, 2), 16, 10).cast("int") * RANGES / 256).cast("int")


def _probes(h: Column, bits: int) -> Column:
    """Places of a hash's bits: pieces of eight hexadecimal digits of it, by the filter's size."""
    return F.array(*[F.pmod(F.conv(F.substring(h, 3 + 8 * k, 8), 16, 10).cast("long"), F.lit(bits)) + 1 for k in range(PROBES)])


def filter_rows(hashes: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """(range, bucket, marks) of hashes (url_hash): the bitmaps that some bit of theirs lies in."""
    each = hashes.select(_range(F.col("url_hash")).alias("range"), F.explode(_probes(F.col("url_hash"), bits)).alias("bit"))
    return each.groupBy("range", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("marks"))


def merged_filter(filters: DataFrame) -> DataFrame:
    return filters.groupBy("range", "bucket").agg(F.bitmap_or_agg("marks").alias("marks"))


def append_seen(articles: DataFrame, path: str, url_col: str = "url", bits: int = RANGE_BITS) -> None:
    """Add the articles' hashes to the history at ``path``, by range, and their bitmaps to its filter. All appends to a path take the same ``bits``.

    The filter comes first: a run that fails between the two leaves bits without hashes, which cost a look and no more.
    """
    hashes = articles.filter(F.col(url_col).isNotNull()).select(url_hash(F.col(url_col)).alias("url_hash")).distinct()
    filter_rows(hashes, bits).write.mode("append").parquet(f"{path}/filter")
    hashes.withColumn("range", _range(F.col("url_hash"))).write.mode("append").partitionBy("range").parquet(f"{path}/hashes")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from ..streaming.state import _existing

    return _existing(spark, path)


def possible_hits(hashes: DataFrame, filters: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """Those of the distinct ``hashes`` (url_hash) all of whose bits are set; none that the history holds is missing."""
    each = hashes.select("url_hash", _range(F.col("url_hash")).alias("range"), F.explode(F.array_distinct(_probes(F.col("url_hash"), bits))).alias("bit"))
    each = each.withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("at", F.bitmap_bit_position("bit"))
    byte = F.conv(F.hex(F.substring("marks", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) > 0
    looked = each.join(merged_filter(filters), ["range", "bucket"], "left").groupBy("url_hash").agg(F.min(F.coalesce(is_set, F.lit(False))).alias("all"))
    return looked.filter("all").select("url_hash")


def unseen_by_filter(articles: DataFrame, path: str, url_col: str = "url", bits: int = RANGE_BITS) -> DataFrame:
    """Articles whose URL the history at ``path`` does not hold: the same rows as an anti-join with all of it.

    Null URLs are unseen; repeated rows all stay or all go. Without a history all rows stay.
    """
    spark = articles.sparkSession
    known, filters = _read(spark, f"{path}/hashes"), _read(spark, f"{path}/filter")
    if known is None or filters is None:
        return articles
    keyed = articles.withColumn("_hash", F.when(F.col(url_col).isNotNull(), url_hash(F.col(url_col))))
    asked = keyed.filter(F.col("_hash").isNotNull()).select(F.col("_hash").alias("url_hash")).distinct()
    hits = possible_hits(asked, filters, bits).withColumn("range", _range(F.col("url_hash")))
    seen = known.join(hits, ["range", "url_hash"], "left_semi").select(F.col("url_hash").alias("_seen")).distinct()
    return keyed.join(seen, F.col("_hash") == F.col("_seen"), "left_anti").drop("_hash")


def false_hit_share(filters: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """(range, share): the share of unseen hashes that a range's filter lets through, by the share of its bits that are set."""
    full = merged_filter(filters).groupBy("range").agg(F.sum(F.bitmap_count("marks")).alias("n"))
    return full.select("range", F.pow(F.col("n") / F.lit(float(bits)), F.lit(float(PROBES))).alias("share"))
