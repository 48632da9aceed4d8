"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage reads all rows that the one before kept, and its decisions take effect: rejected rows are gone. All but the
last return the columns of documents; the last adds copy_no. Columns beyond these are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from briefwell.llm.common import materialize, table
from briefwell.llm.decontaminate import drop_contaminated
from briefwell.llm.mixing import mix
from briefwell.llm.near_dup import drop_near_duplicates
from briefwell.llm.quality import fit_quality, keep_good
from briefwell.llm.queries import toxicity_categories
from briefwell.llm.toxicity import drop_toxic, fit_toxicity


def own_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels of the documents that came this far, so that a sample of them is not spent on documents that are gone."""
    return table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on labelled rows, scores at 0.7 or more."""
    return keep_good(docs, fit_quality(docs, own_labels(spark, docs, sf_dir), "quality"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain gives less than 0.5 for any toxicity."""
    return drop_toxic(docs, fit_toxicity(docs, own_labels(spark, docs, sf_dir), toxicity_categories(), keep=("lang",)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each component of documents alike in 0.8 of their five-word runs."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of ten words of a benchmark item occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, so that sources come near their target weights."""
    return mix(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Fitted models and similarity components are beyond SQL; tests hold the first two stages against
#: their models' scores and the others against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
