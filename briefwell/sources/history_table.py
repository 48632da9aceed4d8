"""Source history as a table by day, bucketed by source: look-back windows read their days only, joins by source do not shuffle it.

A row holds what one source did on one day (the counts of COUNTS, last_selected_at), so a source has one row a day however
many articles it sent, and no bucket grows by a hot one. The table lies at a path of its own; a session that does not know
it opens it by name and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import COUNTS

#: Buckets of the table; the same for all days, as joins need it.
BUCKETS = 32
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def open_history(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of this name at ``path``, created where it is missing; days that other sessions wrote are found."""
    columns = ", ".join(["source_key STRING", *[f"{c} LONG" for c in COUNTS], "last_selected_at STRING", "day DATE"])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (day) CLUSTERED BY (source_key) SORTED BY (source_key) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.createDataFrame([], columns).write.mode("append").partitionBy("day").parquet(path)  # makes the folder, where it is missing
    spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def write_days(counts: DataFrame, name: str) -> None:
    """Write the days of ``counts`` (source_key, day, counts, last_selected_at): a day that is there is replaced, others stay.

    Rows of one source and day are added up first, so a run that is written again changes nothing. Rows without a source
    or a day are left out. One task writes one bucket, so a day has at most one file a bucket.
    """
    spark = counts.sparkSession
    buckets = int(spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Num Buckets'").first()["data_type"])
    kept = counts.filter(F.col("source_key").isNotNull() & F.col("day").isNotNull())
    added = _added(kept, ["source_key", "day"]).select("source_key", *COUNTS, "last_selected_at", "day")
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")  # an option of the writer does not reach tables of the catalog
    try:
        added.repartition(buckets, "source_key").write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(OVERWRITE, before)


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts added up; the later non-empty last_selected_at stays."""
    return rows.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTS], F.max(F.when(F.col("last_selected_at") != "", F.col("last_selected_at"))).alias("last_selected_at"))


def totals(history: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Counts of each source over the days from ``since`` to ``until``, both included: only their folders are read, and nothing is shuffled."""
    rows = history if since is None else history.filter(F.col("day") >= since)
    rows = rows if until is None else rows.filter(F.col("day") <= until)
    return _added(rows, ["source_key"])


def lookback(history: DataFrame, runs: DataFrame, days: int) -> DataFrame:
    """(run_day, source_key, counts, last_selected_at): of each run (run_day) the counts of the ``days`` days up to it.

    The days that any run looks back on are known only when the runs are read; dynamic pruning then leaves other days out.
    """
    first = F.date_sub(F.col("run_day"), days - 1)
    wanted = runs.filter(F.col("run_day").isNotNull()).select("run_day").distinct().withColumn("day", F.explode(F.sequence(first, F.col("run_day"))))
    return _added(history.join(wanted, "day"), ["run_day", "source_key"])


def with_past(rows: DataFrame, history: DataFrame, key: str, since: Column | None = None) -> DataFrame:
    """``rows`` with ``past``, the totals of the source that ``key`` names, or null. Only ``rows`` are shuffled, into the table's buckets."""
    past = totals(history, since)
    past = past.select(F.col("source_key").alias("_source"), F.struct(*COUNTS, "last_selected_at").alias("past"))
    return rows.join(past, F.col(key) == F.col("_source"), "left").drop("_source")
