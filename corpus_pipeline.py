"""A corpus pipeline of five operators: language ID, near-dedup, decontamination, mixing, sharding.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
documents: rows are dropped, or repeated by their mixing rate. Columns beyond those of documents
are carried along. Null texts have no language and go in the first stage; rows that are equal in
id and text are one document, of which near-dedup keeps one row; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.llm import decontamination, language_id, mixing, near_dup, sharding
from tapeline.llm.common import table
from tapeline.session import new_run_dir

#: A document whose best language has a smaller mean posterior is rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no language claims."""
    return language_id.accepted(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the smallest id, then the smallest text hash."""
    return near_dup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains' expected tokens meet their target weights."""
    return mixing.resample(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot along the Hilbert curve; rows of a cell are written together."""
    return sharding.assign(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Trained models and XXH64 fingerprints can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
