"""Accuracy and loss as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradloom.operators.workers import worker_counts


def accuracy(scored: DataFrame, prediction: Column, label: Column) -> DataFrame:
    """Share of rows predicted right, and the row count."""
    right = F.coalesce((prediction == label), F.lit(False)).cast("double")
    return scored.agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def batch_accuracy(scored: DataFrame, prediction: Column, label: Column, batch: int,
                   counts: DataFrame | None = None, drop_remainder: bool = True) -> DataFrame:
    """Mean accuracy over each worker's batches.

    With `drop_remainder` only full batches count and the rows after a worker's last full batch are left out; without it
    the last batch counts as one, however short.
    Worker sizes come from the `worker_rows` column, or from `counts`, one row per worker.
    All counted batches have the same size, so no grouping by batch is needed: one partial and one final aggregate.
    """
    if counts is not None or "worker_rows" not in scored.columns:
        counts = counts if counts is not None else worker_counts(scored)
        scored = scored.drop("worker_rows").join(F.broadcast(counts.select("worker", "worker_rows")), "worker")
    full = F.floor(F.col("worker_rows") / batch) * batch
    right = F.coalesce((prediction == label), F.lit(False)).cast("int")
    if not drop_remainder:
        size = F.least(F.lit(batch), F.col("worker_rows") - F.floor(F.col("pos") / batch) * batch)
        return scored.agg((F.sum(right / size) / F.sum(1 / size)).alias("accuracy"), F.round(F.sum(1 / size)).cast("bigint").alias("batches"))
    kept = scored.filter(F.col("pos") < full)
    return kept.agg((F.sum(right) / F.count(F.lit(1))).alias("accuracy"),
                    F.floor(F.count(F.lit(1)) / batch).alias("batches"))
