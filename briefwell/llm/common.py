"""Shared helpers: reading tables, scratch tables in the cluster's shared folder, bounded batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python. Documents reach hundreds of KB, so rows alone would not bound a batch.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches. The value is the same for every operator, so frames held back run as those built last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset in a local run."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="briefwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/briefwell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs no recomputation of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a materialized frame that no later plan reads."""
    if df is None:
        return
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have shuffle files of finished steps deleted now: Spark's cleaner does so once the driver's JVM has collected their plans, by itself at long intervals.

    A small job first, since Spark holds on to the plan of the last one.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _text, _label, and columns to keep) of documents with one of at most ``limit`` labels: those whose id hashes lowest, so always the same.

    Null labels are left out; an id with several labels or documents gives a row for each pair. The labels' bound makes
    them safe to broadcast, so no text is shuffled.
    """
    chosen = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(limit)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep).join(F.broadcast(chosen), "_id")
