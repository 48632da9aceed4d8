"""Mixing sources to target weights: sizes, water-filled targets, repetition rates and hash-seeded copies. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of one source are dealt to this many salted keys when its rate is joined back.
SALTS = 64
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def target_sizes(sources: DataFrame, weights: tuple[float, ...], max_repeats: float) -> DataFrame:
    """Targets of (source, source_size) rows: (source, source_size, target, rate).

    Sources in code point order (null last) weigh ``weights`` in turn and share the total size by weight. A target stops
    at ``max_repeats`` times its source's size and the excess goes to the others by weight. The level at which the
    water stands follows from running sums over sources by cap / weight: the first k are full if the level that the
    rest would get reaches their caps. One row a source goes through the two sorts, each in one task: sources may be
    many (a million rows of three numbers are small), but they are kinds of origin, not one for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full, full_weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - full) / (F.sum("weight").over(whole) - full_weight)
    # Levels only rise along the order as long as caps below them fill, so the first source that does not fill fixes the level.
    levels = caps.withColumn("level", level).withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(final["level"], F.lit(float("inf"))))
    done = levels.withColumn("target", target)
    return done.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0).alias("rate"))


def unit_hash(columns: list[str], seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns; the same on every run and engine."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """Per row: id, source, size, source_size, target, rate, copies, taken (size * copies).

    copies is floor(rate), plus one if the row's hash falls under the fraction; never above ``max_repeats``. A null text
    has size 0; rows with a null source form one source, last in order; rows with equal ids draw alike. Sizes are
    written once, pre-aggregated per source, and rates come back by salted keys, so a hot source is never one task's.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = target_sizes(totals, weights, max_repeats).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "key")
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
    joined = salted.join(rates, salted["source"].eqNullSafe(rates["key"]) & (salted["salt"] == rates["salt"]))
    whole = F.floor("rate")
    copies = F.least(whole + (unit_hash(["id"], seed) < F.col("rate") - whole).cast("long"), F.lit(int(max_repeats)).cast("long"))
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeats: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> DataFrame:
    """The mixed corpus: every column of ``docs`` and copy_no (from 1); documents whose copies are 0 are absent.

    The rate is joined to the documents by source (salted), so texts stay where they are read if rates are small enough
    for Spark to broadcast, and are never gathered by source otherwise. Nulls, repeated rows and ids are as in
    plan_mix(); a column copy_no of the input is replaced, all others keep their names, whatever these are. An empty
    table gives an empty one.
    """
    own = docs.drop("copy_no")
    packed = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int").alias("own"))
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = target_sizes(totals, weights, max_repeats).select(F.col("source").alias("key"), "rate").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = packed.join(rates, F.col("source").eqNullSafe(F.col("key")) & (F.col("own") == F.col("salt")))
    whole = F.floor("rate")
    copies = F.least(whole + (unit_hash(["id"], seed) < F.col("rate") - whole).cast("long"), F.lit(int(max_repeats)).cast("long"))
    emitted = joined.withColumn("copies", copies).filter("copies > 0")
    return emitted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no")).select("row.*", "copy_no")
