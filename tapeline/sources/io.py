"""Readers and writers of the file-based sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.text import parse_index_list


def read_index_lists(spark: SparkSession, path: str) -> DataFrame:
    """Index membership files, one symbol per line; the file name is the index."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    return parse_index_list(spark.read.text(path).withColumn("index_name", name), keys=("index_name",))


def read_csv_dim(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Headed CSV with a declared schema, every text trimmed."""
    d = spark.read.schema(columns).csv(path, header=True, enforceSchema=False)
    return d.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in d.dtypes])


def read_json_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """JSON objects with nulls left out and ISO dates."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").option("dateFormat", "yyyy-MM-dd").json(path)
