"""N-dimensional array functions. Pairs are each vector and the one with the next id."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradloom.catalog.registry import EMB, Registry, elements, r6, table
from gradloom.functions.ndarray import (nd_add, nd_array, nd_equal, nd_flatten, nd_get, nd_scalar_divide, nd_set, nd_slice,
                                        nd_subarray, nd_subtract, nd_zeros)

REGISTRY = Registry()
query = REGISTRY.query
SHAPE = (4, 4, 4)


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").withColumn("v", nd_array(F.col("embedding").cast("array<double>"), SHAPE))


@query("SELECT vec_id, round(embedding[28]::DOUBLE, 6) + 0.0 AS value FROM embeddings")
def nd_get_element(spark, folder):
    return _vectors(spark, folder).select("vec_id", r6(nd_get(F.col("v"), SHAPE, (1, 2, 3))).alias("value"))


@query(f"WITH {EMB} SELECT vec_id, pos, CASE WHEN pos = 27 THEN 5.0::DOUBLE ELSE round(x, 6) + 0.0 END AS value FROM emb")
def nd_set_element(spark, folder):
    return elements(_vectors(spark, folder), ["vec_id"], nd_set(F.col("v"), SHAPE, (1, 2, 3), 5.0))


@query(f"WITH {EMB} SELECT vec_id, (pos // 16 * 4 + pos % 4)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM emb WHERE (pos // 4) % 4 = 2")
def nd_slice_axis(spark, folder):
    return elements(_vectors(spark, folder), ["vec_id"], nd_slice(F.col("v"), SHAPE, 1, 2))


@query(f"""WITH {EMB}, g AS (SELECT vec_id, x, pos // 16 - 1 AS a, (pos // 4) % 4 - 0 AS b, pos % 4 - 2 AS c FROM emb)
SELECT vec_id, (a * 6 + b * 2 + c)::INTEGER AS pos, round(x, 6) + 0.0 AS value FROM g
WHERE a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 2 AND c BETWEEN 0 AND 1""")
def nd_subarray_box(spark, folder):
    return elements(_vectors(spark, folder), ["vec_id"], nd_subarray(F.col("v"), SHAPE, (1, 0, 2), (3, 3, 4)))


def _pairs(spark, folder):
    v = _vectors(spark, folder).select("vec_id", "v")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


PAIRS = f"""WITH {EMB} SELECT a.vec_id AS vec_id, a.pos AS pos, round(a.x OP b.x, 6) + 0.0 AS value
FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos"""


@query(PAIRS.replace("OP", "+"))
def nd_add_pairs(spark, folder):
    return elements(_pairs(spark, folder), ["vec_id"], nd_add(F.col("v"), F.col("w")))


@query(PAIRS.replace("OP", "-"))
def nd_subtract_pairs(spark, folder):
    return elements(_pairs(spark, folder), ["vec_id"], nd_subtract(F.col("v"), F.col("w")))


@query(f"WITH {EMB} SELECT vec_id, pos, round(x / 0.3::DOUBLE, 6) + 0.0 AS value FROM emb")
def nd_divide(spark, folder):
    return elements(_vectors(spark, folder), ["vec_id"], nd_scalar_divide(F.col("v"), 0.3))


@query(f"""WITH {EMB} SELECT a.vec_id AS vec_id, max(abs(a.x - b.x)) <= 0.4::DOUBLE AS same
FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1 AND b.pos = a.pos GROUP BY a.vec_id""")
def nd_equal_pairs(spark, folder):
    return _pairs(spark, folder).select("vec_id", nd_equal(F.col("v"), F.col("w"), 0.4).alias("same"))


@query(f"WITH {EMB} SELECT vec_id, pos, 64 AS extent, round(x, 6) + 0.0 AS value FROM emb")
def nd_flatten_zeros(spark, folder):
    """A flattened array plus zeros of its shape is the array."""
    flat, shape = nd_flatten(F.col("v"), SHAPE)
    df = _vectors(spark, folder).withColumn("extent", F.lit(shape[0]))
    return elements(df, ["vec_id", "extent"], nd_add(flat, nd_zeros(SHAPE, "double")))
