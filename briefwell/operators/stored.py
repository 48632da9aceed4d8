"""Tables written between steps: long expressions are cut, rows used twice are computed once, and lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder (a local one in a local run where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="steps-")
    return f"{base.rstrip('/')}/steps/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a shared folder and read back."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, to be sorted and merged.

    A planner takes texts and arrays for shorter than they are, and columns of a wide table for a share of its file, so it
    would bring such a side to the driver and send it to all tasks.
    """
    return df.hint("merge")
