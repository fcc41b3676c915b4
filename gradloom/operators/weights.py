"""The weights table: (layer, blob, shape, chunk, values), at most CHUNK values per row.

Optimizer state travels as further rows whose layer ends in `/momentum`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradloom.functions.fill import filler_value, uniform
from gradloom.functions.ndarray import nd_equal
from gradloom.plans.net import Net, Param
from gradloom.session import shuffle_partitions
from gradloom.plans.batches import CHUNK, WEIGHTS_SCHEMA, check_weights, pack, unpack

MOMENTUM = "/momentum"


def declared_chunks(spark: SparkSession, net: Net) -> DataFrame:
    """(layer, blob, shape, size, chunk): the rows a net's weights table must have. Tiny: one seed row per blob."""
    blobs = [(p.layer, p.blob, list(p.shape), p.size) for p in net.params()]
    declared = spark.createDataFrame(blobs, "layer string, blob int, shape array<int>, size bigint")
    last = F.floor((F.col("size") - 1) / CHUNK).cast("int")
    return declared.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))


def init_weights(spark: SparkSession, net: Net, seed: int = 0) -> DataFrame:
    """Initial weights drawn by each blob's filler, chunk by chunk in parallel, equal for every worker.

    A value is a function of seed, layer, blob and place in the blob, so it depends neither on partitioning nor on the other blobs.
    """
    chunks = declared_chunks(spark, net).repartition(shuffle_partitions(spark), "layer", "blob", "chunk")
    first = F.col("chunk").cast("bigint") * CHUNK
    places = F.sequence(first, F.least(first + CHUNK, F.col("size")) - 1)
    values = F.lit(None).cast("array<double>")
    for param in net.params():
        here = (F.col("layer") == param.layer) & (F.col("blob") == param.blob)
        values = F.when(here, F.transform(places, filling(param, seed))).otherwise(values)
    return chunks.select("layer", "blob", "shape", "chunk", values.alias("values"))


def filling(param: Param, seed: int) -> Callable[[Column], Column]:
    """A blob's value by place."""
    return lambda place: filler_value(param.filler, param.shape, uniform(seed, F.lit(param.layer), F.lit(param.blob), place))


def average_weights(local: DataFrame, workers: int | None = None, weight: str | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of the workers' weights, chunk by chunk, with partial sums per task.

    Shapes must agree and, when `workers` is given, every worker must have contributed. `weight` names a column for
    a weighted mean; `by` names columns that keep separate averages.
    """
    mean = Summarizer.mean(array_to_vector("values"), *([F.col(weight).cast("double")] if weight else []))
    merged = local.groupBy(*by, "layer", "blob", "chunk").agg(
        F.min("shape").alias("shape"), F.max("shape").alias("other"), F.count(F.lit(1)).alias("copies"),
        vector_to_array(mean).alias("values"))
    fits = F.col("shape") == F.col("other")
    if workers is not None:
        fits = fits & (F.col("copies") == workers)
    problem = F.raise_error(F.concat_ws("/", F.lit("weights do not match"), "layer", F.col("blob").cast("string")))
    return merged.select(*by, "layer", "blob", "shape", "chunk", F.when(fits, F.col("values")).otherwise(problem).alias("values"))


def scalar_divide(weights: DataFrame, divisor) -> DataFrame:
    divisor = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    return weights.withColumn("values", F.transform("values", lambda x: x / divisor))


def add_weights(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum; both tables must have the same blobs and shapes."""
    problem = F.raise_error(F.concat_ws("/", F.lit("weights do not match"), "layer", F.col("blob").cast("string")))
    joined = a.join(b.select("layer", "blob", "chunk", F.col("shape").alias("other"), F.col("values").alias("more")),
                    ["layer", "blob", "chunk"], "full")
    fits = F.coalesce((F.col("shape") == F.col("other")) & (F.size("values") == F.size("more")), F.lit(False))
    total = F.zip_with("values", "more", lambda x, y: x + y)
    return joined.select("layer", "blob", "shape", "chunk", F.when(fits, total).otherwise(problem).alias("values"))


def weights_equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """One row `equal`: same blobs, shapes and values within `tolerance`."""
    joined = a.join(b.select("layer", "blob", "chunk", F.col("shape").alias("other"), F.col("values").alias("more")),
                    ["layer", "blob", "chunk"], "full")
    same = F.coalesce(F.col("shape") == F.col("other"), F.lit(False)) & nd_equal(F.col("values"), F.col("more"), tolerance)
    return joined.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def l2_term(weights: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """One row `l2`: the sum over the named layers of `coefficient * sum(w ** 2) / 2`."""
    squares = F.aggregate("values", F.lit(0.0), lambda t, x: t + x * x)
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in coefficients.items() for x in pair]), F.col("layer"))
    return weights.filter(F.col("layer").isin(list(coefficients))).agg(
        F.coalesce(F.sum(factor * squares) / 2, F.lit(0.0)).alias("l2"))


def blob_values(weights: DataFrame, layer: str, blob: int) -> DataFrame:
    """One row, one column: the flat values of a blob. For layers that fit into a row."""
    rows = weights.filter((F.col("layer") == layer) & (F.col("blob") == blob))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "values")))
    return rows.agg(F.flatten(F.transform(ordered, lambda s: s["values"])).alias("values"))


def matrix_rows(weights: DataFrame, layer: str, outputs: int, inputs: int) -> DataFrame:
    """One row, one column: a dense layer's weights as one inner array per output."""
    flat = blob_values(weights, layer, 0)
    return flat.select(F.transform(F.sequence(F.lit(0), F.lit(outputs - 1)), lambda o: F.slice(
        F.col("values"), o * inputs + 1, F.lit(inputs))).alias("rows"))


def weights_to_dict(weights: DataFrame, net: Net) -> dict[tuple[str, int], np.ndarray]:
    """A net's weights on the driver, checked against its blobs. Their size is the net's, not the data's."""
    blobs = unpack(weights.filter(~F.col("layer").endswith(MOMENTUM)).toArrow(), net.dtype)
    check_weights(net, blobs)
    return blobs


def weights_from_dict(spark: SparkSession, blobs: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """Driver arrays as a weights table, for small nets and tests."""
    return spark.createDataFrame(pack(blobs), WEIGHTS_SCHEMA)
