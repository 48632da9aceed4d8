"""State of a run that outlives it: feedback entries with a high-water mark, and source history as keyed state.

Both write one folder a batch, ``run=R/made_by=M/batch=B``: R counts checkpoints, M tells a checkpoint. A batch that runs again
writes its own folder anew, so nothing is counted twice; a new checkpoint starts from what earlier runs left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.history import COUNTS

TOTALS = StructType([StructField("source_key", StringType()), *[StructField(c, LongType()) for c in COUNTS], StructField("last_selected_at", StringType()), StructField("last_seen_at", StringType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet."""
    try:
        table = spark.read.parquet(path)
        table.schema  # noqa: B018
        return table
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return None


def _run_of(spark: SparkSession, path: str, checkpoint: str) -> tuple[int, str]:
    """The number and mark of a checkpoint's run: its own if it wrote before, else the next one."""
    mark = hashlib.md5(checkpoint.encode()).hexdigest()
    known = _existing(spark, path)
    runs = {m: r for r, m in (known.select("run", "made_by").distinct().collect() if known is not None else [])}  # a row a checkpoint
    return runs.get(mark, max(runs.values(), default=-1) + 1), mark


def _write(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def feedback_entries(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The entries that sync_feedback() kept, or None."""
    known = _existing(spark, f"{table_path}/entries")
    return None if known is None else known.drop("run", "made_by", "batch")


def feedback_mark(spark: SparkSession, table_path: str, before_run: int | None = None) -> int | None:
    """The largest id that was read, also of messages that were no feedback; of runs before ``before_run``, where given."""
    known = _existing(spark, f"{table_path}/marks")
    if known is None:
        return None
    return (known if before_run is None else known.filter(F.col("run") < before_run)).agg(F.max("high")).first()[0]


def sync_feedback(stream: DataFrame, table_path: str, checkpoint: str, key: str = "update_id", flag: str | None = None, at: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Keep each message once by ``key``; those whose ``flag`` is not true are skipped, but move the mark too.

    Ids up to the mark of earlier checkpoints are passed over, as the chat's own offset does. Within a checkpoint the
    stream drops repeated ids: those within ``delay`` of each other by the time ``at``, whose state Spark forgets
    after that, or all, where there is no time. Messages without an id are left out.
    """
    spark = stream.sparkSession
    run, mark = _run_of(spark, f"{table_path}/marks", checkpoint)
    past = feedback_mark(spark, table_path, run)
    new = stream.filter(F.col(key).isNotNull() if past is None else F.col(key) > past)
    once = new.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if at else new.dropDuplicates([key])

    def add(batch: DataFrame, number: int) -> None:
        folder = f"run={run}/made_by={mark}/batch={number}"
        wanted = batch.filter(F.col(flag)).drop(flag) if flag else batch
        _write(wanted, f"{table_path}/entries/{folder}")
        _write(batch.agg(F.max(key).cast("long").alias("high")), f"{table_path}/marks/{folder}")  # last: only a whole batch moves the mark

    return once.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SourceTotals(StatefulProcessor):
    """Running counts of one source. Rows older than the newest one seen by more than ``lateness`` seconds are given back as they are, uncounted."""

    def __init__(self, lateness: float | None):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", StructType(TOTALS.fields[1:]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.totals.update((*[int(row[c] or 0) for c in COUNTS], str(row["last_selected_at"] or ""), str(row["last_seen_at"] or "")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *counts, selected, seen = self.totals.get() if self.totals.exists() else (*[0] * len(COUNTS), "", "")
        newest, late, counted = seen, [], False
        for frame in rows:
            told = frame["last_seen_at"].fillna("")
            if self.lateness is not None and seen:
                age = pd.to_datetime(seen, utc=True) - pd.to_datetime(told.where(told != ""), utc=True, format="ISO8601")
                old = (age.dt.total_seconds() > self.lateness).to_numpy()
                if old.any():
                    late.append(frame[old])
                    frame, told = frame[~old], told[~old]
            if len(frame):
                counted = True
                counts = [n + int(x) for n, x in zip(counts, frame[list(COUNTS)].fillna(0).sum())]
                selected, newest = max([selected, *frame["last_selected_at"].fillna("")]), max([newest, *told])
        if counted:
            self.totals.update((*counts, selected, newest))
            yield pd.DataFrame([[key[0], *counts, selected, newest, False]], columns=[*TOTALS.fieldNames(), "late"])
        for frame in late:
            yield frame[TOTALS.fieldNames()].assign(late=True)

    def close(self) -> None:
        pass


def keep_source_history(stream: DataFrame, table_path: str, checkpoint: str, lateness: float | None = None) -> StreamingQuery:
    """Add counts (source_key, counts, last_selected_at, optionally last_seen_at as ISO text) to the totals of their sources.

    Totals are keyed state: a batch reads and writes only its own sources and appends their new totals to the table.
    With ``lateness`` (seconds), rows that come later than that after the newest row of earlier batches of their source go
    to ``late`` beside the totals and are not counted. Null counts are 0; rows without a source are left out.
    """
    spark = stream.sparkSession
    run, mark = _run_of(spark, f"{table_path}/totals", checkpoint)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in stream.columns else F.lit("").alias(c) for c in ("last_selected_at", "last_seen_at")]
    rows = stream.filter(F.col("source_key").isNotNull()).select("source_key", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTS], *texts)
    start = newest_source_history(spark, table_path, run)
    start = spark.createDataFrame([], TOTALS) if start is None else start.select(*TOTALS.fieldNames())
    provider = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # keyed state needs it; a query keeps what it was started with
    try:
        totals = rows.groupBy("source_key").transformWithStateInPandas(SourceTotals(lateness), StructType([*TOTALS.fields, StructField("late", BooleanType())]), "Update", "None", start.groupBy("source_key"))

        def add(batch: DataFrame, number: int) -> None:
            kept = batch.persist()  # both parts come from one pass over the state
            for name, test in (("late", F.col("late")), ("totals", ~F.col("late"))):
                _write(kept.filter(test).drop("late"), f"{table_path}/{name}/run={run}/made_by={mark}/batch={number}")
            kept.unpersist()

        return totals.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(provider, usual)


def newest_source_history(spark: SparkSession, table_path: str, before_run: int | None = None) -> DataFrame | None:
    """Each source's newest totals (of runs before ``before_run``, where given), or None where there are none."""
    known = _existing(spark, f"{table_path}/totals")
    if known is None:
        return None
    rows = known if before_run is None else known.filter(F.col("run") < before_run)
    newest = rows.groupBy("source_key").agg(F.max_by(F.struct(*TOTALS.fieldNames()[1:]), F.struct("run", "batch")).alias("t"))
    return newest.select("source_key", "t.*")


def late_source_rows(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The rows that came too late to be counted, or None."""
    known = _existing(spark, f"{table_path}/late")
    return None if known is None else known.drop("run", "made_by", "batch")
