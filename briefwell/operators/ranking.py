"""Ranking: diverse top-k, quotas, per-lane top-k, cut-offs, share caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import grown, stored


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The k first rows of each group; k <= 0: all."""
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(place) <= k) if k > 0 else ranked


def diverse_top(rows: DataFrame, kind: str, order: list[Column], k: int) -> DataFrame:
    """The best row of each kind first, then the best of the rest, k in all; ``place`` from 1.

    Only the k best of each kind can get in, so the sort over all of them meets at most k rows a kind.
    """
    best = top_per_group(rows, [kind], order, k, "_in_kind")
    return best.orderBy((F.col("_in_kind") > 1).cast("int"), *order).limit(k).withColumn("place", F.row_number().over(Window.orderBy((F.col("_in_kind") > 1).cast("int"), *order))).drop("_in_kind")


def quota_split(rows: DataFrame, is_side: Column, kind: str, order: list[Column], most: int) -> DataFrame:
    """Every row with ``selected``: side rows get what the main quota of two thirds leaves, and gaps are filled by rank.

    The main rows are chosen for diversity. Row counts are taken first; the choices are small frames that are joined back.
    """
    marked = rows.withColumn("_side", is_side)
    n_main, n_side = marked.agg(F.count(F.when(~F.col("_side"), 1)), F.count(F.when(F.col("_side"), 1))).first()
    main_quota = min(n_main, max(1, most if not n_side else (most * 2 + 2) // 3))
    side_quota = min(n_side, most - main_quota)
    main = diverse_top(marked.filter(~F.col("_side")), kind, order, main_quota).select("ord")
    side = marked.filter("_side").orderBy(*order).limit(side_quota).select("ord")
    chosen = main.unionByName(side)
    rest = marked.join(chosen, "ord", "left_anti").orderBy(*order).limit(max(0, most - main_quota - side_quota)).select("ord")
    picked = chosen.unionByName(rest).withColumn("selected", F.lit(True))
    return marked.drop("_side").join(picked, "ord", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def score_cutoff(rows: DataFrame, score: str, default: int = 55, share: float = 0.7) -> DataFrame:
    """(n, cutoff): the score at place int(n * share) of the ascending order for more than five rows, else the default.

    Scores are counted first, so the running sum meets one row a distinct score.
    """
    counts = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("m"))
    running = counts.withColumn("upto", F.sum("m").over(Window.orderBy("s"))).withColumn("n", F.sum("m").over(Window.partitionBy(F.lit(0))))
    at = F.floor(F.col("n") * F.lit(float(share)))
    found = running.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min(F.when(F.col("upto") > at, F.col("s"))).alias("c"))
    return found.select(F.col("n").cast("long").alias("n"), F.when(F.col("n") > 5, F.col("c")).otherwise(F.lit(default)).cast("long").alias("cutoff"))


def first_rows(rows: DataFrame, order: list[Column], n: int, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of the ``n`` first rows by ``order``, for an ``n`` that grows with the table.

    Range partitions are sorted each on its own; their sizes tell in which one the n-th row lies, and a filter on partition
    and place keeps what comes before. ``order`` should tell rows apart; of rows that tie over the cut some stay.
    """
    spark = rows.sparkSession
    columns = keep or rows.columns
    if n <= 0:
        return rows.select(*columns).limit(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias("_n"))
    placed = stored(placed.withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND((1 << 33) - 1)), "ranked")
    left, cut = n, None
    for part, size in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):  # a row a partition
        if size >= left:
            cut = part
            break
        left -= size
    kept = placed if cut is None else placed.filter((F.col("_part") < cut) | (F.col("_part") == cut) & (F.col("_n") < left))
    return kept.select(*columns)


def numbered(rows: DataFrame, key: str, order: list[Column], name: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``name``: each row's place within its key by ``order``, from 1, also for keys that hold a share of all rows.

    A window would sort a key in one task. Here range partitions by key and order are numbered each on its own, and a key
    that goes on over several partitions takes up where the one before left it. Rows without a key are left out.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.filter(F.col(key).isNotNull())
    placed = known.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(*dict.fromkeys([*keep, key]), F.monotonically_increasing_id().alias("_n"))
    placed = stored(placed.withColumn("_part", F.shiftright("_n", 33)), "numbered")
    starts = placed.groupBy("_part", key).agg(F.min("_n").alias("_first"), F.count("*").alias("_m"))
    earlier = F.sum("_m").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = starts.select("_part", key, (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return placed.join(grown(offsets), ["_part", key]).select(*keep, (F.col("_n") + F.col("_add")).cast("int").alias(name))


def cap_share(rows: DataFrame, is_side: Column, order: list[Column], share: float = 0.3, alone: int = 3) -> DataFrame:
    """Side rows cut to ``share`` of the result: int(n * share / (1 - share)) of them for n others, ``alone`` if there are no others."""
    marked = rows.withColumn("_side", is_side)
    n = marked.filter(~F.col("_side")).count()
    most = int(n * share / (1 - share)) if n else alone
    side = first_rows(marked.filter("_side"), order, most)
    return marked.filter(~F.col("_side")).unionByName(side).drop("_side")
