"""Saved weights and training history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.plans.net import Net
from gradloom.operators.weights import CHUNK, WEIGHTS_SCHEMA, declared_chunks


def save_weights(weights: DataFrame, path: str) -> None:
    weights.select("layer", "blob", "shape", "chunk", "values").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, net: Net | None = None) -> DataFrame:
    """Saved weights. With a net, exactly its layers are taken by name, and a missing or misshapen blob is an error."""
    saved = spark.read.schema(WEIGHTS_SCHEMA).parquet(path)
    if net is None:
        return saved
    declared = declared_chunks(spark, net).withColumnRenamed("shape", "declared")
    length = F.least(F.lit(CHUNK), F.col("size") - F.col("chunk") * CHUNK)
    fits = F.coalesce((F.col("shape") == F.col("declared")) & (F.size("values") == length), F.lit(False))
    problem = F.concat_ws("/", F.lit("saved weights do not fit"), "layer", F.col("blob").cast("string"))
    return declared.join(saved, ["layer", "blob", "chunk"], "left").select(
        "layer", "blob", F.col("declared").alias("shape"), "chunk",
        F.when(fits, F.col("values")).otherwise(F.raise_error(problem)).alias("values"))


HISTORY_SCHEMA = "round int, elapsed_s double, metric string, value double"


def append_history(history: DataFrame, path: str) -> None:
    history.write.mode("append").parquet(path)
