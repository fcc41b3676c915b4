"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from gradloom.session import shuffle_partitions


def hot_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, __salts) of the keys that hold more rows than one of `tasks` tasks should: fewer than `tasks` keys.

    A key is dealt over as many salts as it has such shares, so the salts of all keys are at most twice the tasks.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    shares = F.ceil(F.col("__n") * tasks / F.col("__total")).cast("int")
    return counts.withColumn("__total", total).filter(F.col("__n") * tasks > F.col("__total")).select(key, shares.alias("__salts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Inner or left equi-join over `tasks` tasks (the session's shuffle width); the left rows of a hot key are dealt over several.

    Only the hot keys' right rows are copied, once per salt. A row's salt is a hash of its plain values (no bytes or arrays, which may be
    whole images) and of the input partition it is in: a repeated task deals alike, and even full copies of one row are spread. The list of hot keys
    is the one side broadcast here; it has fewer rows than there are tasks.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join is inner or left")
    hot = F.broadcast(hot_keys(left.select(key), key, tasks or shuffle_partitions(left.sparkSession)))
    salts = F.coalesce("__salts", F.lit(1))
    plain = [f.name for f in left.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType))]
    dealt = F.pmod(F.xxhash64(*plain, F.spark_partition_id()), salts).cast("int")
    salted_left = left.join(hot, key, "left").withColumn("__salt", dealt).drop("__salts")
    salted_right = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return salted_left.join(salted_right, [key, "__salt"], how).drop("__salt")


def attach_labels(images: DataFrame, labels: DataFrame, on_missing: str = "error", key: str = "filename",
                  label: str = "label") -> DataFrame:
    """Add the label of each image's key. A key without label fails the job, or drops the row (`drop`).

    Labels hold one row per key (see `read_labels`); many images may share a key. To find hot keys the images are read
    twice more, for their key only, so store them first when they are expensive to make.
    """
    if on_missing not in ("error", "drop"):
        raise ValueError(f"on_missing is error or drop, not {on_missing}")
    labels = labels.select(key, label)
    if on_missing == "drop":
        return salted_join(images, labels, key, "inner")
    joined = salted_join(images, labels.withColumn("__found", F.lit(True)), key, "left")
    missing = F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string")))
    return joined.withColumn(label, F.when(F.col("__found"), F.col(label)).otherwise(missing)).drop("__found")


def missing_labels(images: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    """Keys of images that have no label, once each. Keys are made distinct before they are shuffled to the join."""
    return images.select(key).distinct().join(labels.select(key), key, "left_anti")


def missing_images(labels: DataFrame, images: DataFrame, key: str = "filename") -> DataFrame:
    """Keys of label rows that have no image, once each."""
    return missing_labels(labels, images, key)


def gather(labels: DataFrame, images: DataFrame, key: str = "filename", on_missing: str = "error") -> DataFrame:
    """Fetch the images of every label row. Both sides are large; the images of one name may be many.

    A label without image fails the job, or is dropped (`drop`; `missing_images` names those).
    """
    if on_missing not in ("error", "drop"):
        raise ValueError(f"on_missing is error or drop, not {on_missing}")
    found = salted_join(images, labels, key, "inner")
    if on_missing == "drop":
        return found
    failed = F.raise_error(F.concat(F.lit("no image for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    lost = missing_images(labels, images, key)
    return found.unionByName(lost.select(*[failed.cast(f.dataType).alias(f.name) for f in found.schema]))
