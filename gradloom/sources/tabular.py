"""Small and tabular sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradloom.operators.numbering import hash_bucket, number_rows
from gradloom.session import stored

#: Of a sample id, the bits that are the row's place in its file.
PLACE_BITS = 36


def create_samples(spark: SparkSession, rows: Iterable[tuple], schema: str | T.StructType) -> DataFrame:
    """Driver rows as a sample table; meant for small inputs, files are scanned instead."""
    return spark.createDataFrame(list(rows), schema)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with a unique `sample_id`, file number and place in the file: equal on every run, also for row copies.

    Files are numbered in the order of a hash of their paths, by Spark; the numbers are a table that is joined without a hint, so
    that it is broadcast while it is small and shuffled when there are very many files.
    """
    df = spark.read.parquet(path)
    file = F.col("_metadata.file_path").alias("__file")
    order = [F.xxhash64("__file"), F.col("__file")]
    files = number_rows(df.select(file).distinct(), [], order, hash_bucket(order[0], 8), "__number")
    placed = df.select("*", file, F.col("_metadata.row_index").alias("__place")).join(stored(files, "file-numbers"), "__file")
    return placed.select((F.shiftleft("__number", PLACE_BITS) + F.col("__place")).alias("sample_id"), *df.columns)


def read_csv_features(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A CSV file without header as columns C0, C1, ... A given schema saves the pass that infers the types."""
    reader = spark.read.option("ignoreLeadingWhiteSpace", True)
    df = reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True)
    return df.toDF(*[f"C{i}" for i in range(len(df.columns))])
