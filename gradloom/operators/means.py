"""Mean vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradloom.functions.shapes import indexed, volume
from gradloom.plans.batches import StoredVector, matrix
from gradloom.session import stored


#: Values of a mean image that travel in one row.
CHUNK = 4096


def mean_by_position(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., pos, n, mean): exact sums per position, combined before the shuffle. Integers are summed as integers."""
    elements = indexed(df, by, F.col(col), "pos", "x")
    return elements.groupBy(*by, "pos").agg(F.count("x").alias("n"), (F.sum("x") / F.count("x")).alias("mean"))


def mean_vector(df: DataFrame, col: str) -> DataFrame:
    """One row `mean array<double>`: a JVM aggregate with partial sums per task."""
    summary = Summarizer.mean(array_to_vector(F.col(col)))
    return df.agg(vector_to_array(summary).alias("mean"))


def mean_chunks(df: DataFrame, col: str, shape: Sequence[int]) -> DataFrame:
    """(chunk, values) of the mean of a `binary` or array column, for large images.

    Each task adds whole Arrow batches into one running sum (64-bit integers for bytes) and emits it once, in chunks,
    which the shuffle adds up as vectors: a few rows per task, not one per pixel.
    """
    n = volume(shape)
    integer = isinstance(df.schema[col].dataType, T.BinaryType)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            values = matrix(batch.column(0), n)
            part = values.sum(axis=0, dtype="i8" if integer else "f8")
            total = part if total is None else total + part
            rows += len(values)
        if rows:
            parts = [total[at:at + CHUNK].astype("f8") for at in range(0, n, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([rows] * len(parts), pa.int64()), pa.array(parts)],
                                             ["chunk", "n", "sums"])

    partial = df.select(col).mapInArrow(sums, "chunk int, n bigint, sums array<double>")
    merged = partial.groupBy("chunk").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return merged.select("chunk", F.transform("sums", lambda s: s / F.col("n")).alias("values"))


def mean_image(df: DataFrame, col: str, shape: Sequence[int]) -> DataFrame:
    """One row `mean array<double>` (see `mean_chunks`)."""
    return mean_chunks(df, col, shape).agg(F.flatten(as_array("chunk", "values")).alias("mean"))


def publish_mean(df: DataFrame, col: str, shape: Sequence[int]) -> StoredVector:
    """The mean image, computed once, written to the shared folder and read by the tasks that need it, as weights are.

    A table without rows has no mean, which is an error. One file: the size is that of one image.
    """
    kept = stored(mean_chunks(df, col, shape).coalesce(1), "mean")
    if kept.isEmpty():
        raise ValueError(f"no rows to take the mean of {col} from")
    return StoredVector(tuple(kept.inputFiles()), volume(shape))


def as_array(position: str, value: str) -> Column:
    """Aggregate (position, value) rows of one array back into it."""
    return F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda s: s[value])
