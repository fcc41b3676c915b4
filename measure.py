"""

Inputs are the test tables; 256 x 256 images are embeddings tiled to that size. Each line is the best of three.
"""

from __future__ import annotations

import os
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradloom.catalog.preparation import pixel_bytes  # noqa: E402
from gradloom.catalog.registry import table  # noqa: E402
from gradloom.catalog.scoring import NET, fixed_weights, logits  # noqa: E402
from gradloom.functions.convert import to_float_vector  # noqa: E402
from gradloom.functions.image import crop_centred, crop_corner, crop_pixels, random_crop, subtract_mean  # noqa: E402
from gradloom.operators.means import mean_by_position, mean_image, mean_vector  # noqa: E402
from gradloom.operators.samples import with_scalar  # noqa: E402
from gradloom.operators.score import forward  # noqa: E402
from gradloom.operators.train import local_sgd_round  # noqa: E402
from gradloom.operators.weights import average_weights, init_weights  # noqa: E402
from gradloom.operators.workers import assign_workers, round_window, worker_counts  # noqa: E402
from gradloom.plans import net as n  # noqa: E402
from gradloom.plans.batches import matrix  # noqa: E402
from gradloom.plans.solver import Solver  # noqa: E402
from gradloom.session import cut_lineage, ship  # noqa: E402


MEAN, SHAPE, CROP = np.full(3 * 65536, 120.0), (3, 256, 256), (227, 227)


def best_of_three(build) -> float:
    best = None
    for _ in range(3):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        best = took if best is None else min(best, took)
    return best


def image_tables(spark, folder, parts):
    """256 colour images, 256 gray ones as bytes and as floats, all cached."""
    emb = table(spark, folder, "embeddings")
    tiled = emb.limit(256).select(F.col("vec_id").alias("sample_id"), F.unhex(
        F.repeat(F.hex(pixel_bytes()), 3 * 1024)).alias("data")).repartition(parts).cache()
    gray = tiled.select("sample_id", F.substring("data", 1, 65536).alias("data")).cache()
    floats = gray.select("sample_id", to_float_vector(gray, "data", (256, 256)).alias("data")).cache()
    for t in (tiled, gray, floats):
        t.count()
    return tiled, gray, floats


def crop_in_batch(tiled):
    """Mean subtraction and crop of every image inside the task; only the seconds spent come back."""
    row, col = crop_corner(F.col("sample_id"), SHAPE, CROP)
    mean = MEAN.reshape(SHAPE).astype("f4")

    def run(batches):
        for batch in batches:
            images = matrix(batch.column("data"), 3 * 65536).reshape(-1, *SHAPE)
            began = time.perf_counter()
            crop_pixels(images, mean, batch.column("r").to_numpy(), batch.column("c").to_numpy(), CROP)
            yield pa.RecordBatch.from_arrays([pa.array([time.perf_counter() - began])], ["seconds"])

    return tiled.select("data", row.alias("r"), col.alias("c")).mapInArrow(run, "seconds double")


def reference_checks(spark, folder, cpus) -> dict[str, float]:
    tiled, gray, floats = image_tables(spark, folder, int(cpus))
    out = {"convert_256_bytes": best_of_three(lambda: gray.select(to_float_vector(gray, "data", (256, 256)))),
           "convert_256_floats": best_of_three(lambda: floats.select(to_float_vector(floats, "data", (256, 256)))),
           "crop_256_job": best_of_three(lambda: crop_in_batch(tiled)),
           "crop_256_one_thread": min(crop_in_batch(tiled).agg(F.sum("seconds")).first()[0] for _ in range(3))}
    for t in (tiled, gray, floats):
        t.unpersist()
    return {name: round(seconds, 4) for name, seconds in out.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)

    def timed(label, build, rows=None):
        best = best_of_three(build)
        print(f"{label}: {best:.3f} s" + (f", {rows / best:,.0f} rows/s" if rows else ""), flush=True)

    for name, seconds in reference_checks(spark, folder, cpus).items():
        print(f"{name}: {seconds:.3f} s", flush=True)
    emb = table(spark, folder, "embeddings")
    tiled, _, _ = image_tables(spark, folder, int(cpus))
    mean, shape, crop = MEAN, SHAPE, CROP
    row, col = crop_corner(F.col("sample_id"), shape, crop)
    cornered = tiled.withColumns({"crop_row": row, "crop_col": col, "label": F.lit(0)})
    timed("mean and crop to 227x227, 256 images, floats back to Spark",
          lambda: cornered.select(crop_centred(F.col("data"), mean, shape, crop, F.col("crop_row"), F.col("crop_col"))), 256)
    vector = to_float_vector(tiled, "data", shape)
    timed("the same as column expressions",
          lambda: with_scalar(tiled, "mean", mean_image(tiled, "data", shape)).select(
              random_crop(subtract_mean(vector, F.col("mean")), shape, crop, F.col("sample_id"))), 256)
    timed("mean vector 64, by position", lambda: mean_by_position(emb, "embedding"), 2000)
    timed("mean vector 64, summary", lambda: mean_vector(emb, "embedding"), 2000)
    timed("mean image 3x256x256, 256 images", lambda: mean_image(tiled, "data", shape), 256)

    weights = fixed_weights(spark, NET)
    wide = emb.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("copy")).repartition(int(cpus)).cache()
    total = wide.count()
    timed("dense 64 x 10, batches", lambda: forward(wide, NET, weights, ["prob"], ["vec_id"]), total)
    timed("dense 64 x 10, column expressions", lambda: logits(spark, folder), emb.count())

    lines = table(spark, folder, "lineitem").select(
        F.monotonically_increasing_id().alias("sample_id"),
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("data"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))
    timed("assign 600,000 rows to 8 workers", lambda: assign_workers(lines, 8), 600_000)
    assigned = assign_workers(lines, 8).cache()
    counts = cut_lineage(worker_counts(assigned))
    net = n.softmax_regression(4, 3)
    start = cut_lineage(init_weights(spark, net, 0))
    window = round_window(assigned, counts, 10, 100, 0)
    local = lambda: local_sgd_round(window, start, net, Solver(0.1, 0.9), 8, 10, 100)
    timed("round of 8 workers x 10 steps x 100 rows, local part", local)
    timed("the same with the average", lambda: average_weights(local(), 8))


if __name__ == "__main__":
    main()
