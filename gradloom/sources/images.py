"""Decoded, resized images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.functions.image import to_planar_rgb
from gradloom.session import lifetime, shared_path, shuffle_partitions, stored
from gradloom.sources.archives import attach_index_labels, land_members
from gradloom.sources.files import basename, read_ranges

#: Archive members that are landed as files at a time.
GROUP_BYTES = 64 << 30
#: Disk that a file takes besides its bytes, about, and the least disk that a group is made for: below it the fixed cost of a group, not its images, would be the time.
FILE_BYTES, LEAST_GROUP_BYTES = 4096, 256 << 20


def decode_resize(images: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """(filename, data) from Spark's `image` column: planar bytes of the forced size; undecodable images are dropped."""
    return images.filter(F.col("image").isNotNull() & (F.col("image.height") > 0)).select(
        # Origins are escaped paths, in which a plus sign stands for itself.
        F.url_decode(F.replace(basename(F.col("image.origin")), F.lit("+"), F.lit("%2B"))).alias("filename"),
        to_planar_rgb(F.col("image"), height, width).alias("data"))


def read_images(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Image files below `path`, decoded in the JVM; files that are not images are dropped."""
    reader = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
    return decode_resize(reader.load(path), height, width)


def read_archived_images(members: DataFrame, directory: str, height: int, width: int) -> DataFrame:
    """Decode archive members: they are landed in `directory` as files, then read as images under their own name."""
    landed = land_members(members, directory)
    landed.write.format("noop").mode("overwrite").save()
    images = read_images(members.sparkSession, directory, height, width)
    return images.withColumn("filename", F.regexp_replace("filename", "^[0-9A-F]+-", ""))


def read_labelled_images(index: DataFrame, labels: DataFrame, height: int, width: int, on_missing: str = "drop",
                         group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """(filename, label, data) of the archive members that have a label and can be decoded, as a stored table, and how many were
    (read, kept, dropped), one row.

    Labels meet the index, not the images. Then groups of members, `group_bytes` of them at a time, are read by range, landed,
    decoded where the files lie, and appended; groups that would take less disk than LEAST_GROUP_BYTES are made larger. A member's label travels in the name of its file, so no exchange carries an image. Each group's
    folder is deleted once it is stored: neither files nor listings grow with the whole input.
    """
    spark = index.sparkSession
    kind = labels.schema["label"].dataType
    with lifetime(spark):
        found = stored(attach_index_labels(index, labels, on_missing), "labelled-index")
        # A label that stands twice is an image that is there twice.
        size, files = found.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        groups = max(1, min(math.ceil(size / group_bytes), math.ceil((size + files * FILE_BYTES) / LEAST_GROUP_BYTES)))
        group = F.pmod(F.xxhash64("path", "offset"), F.lit(groups)).alias("group")
        members = stored(found.groupBy("path", "parent", "member", "offset", "size", "filename", "label", group).agg(F.count(F.lit(1)).alias("copies")), "members")
        text = F.hex(F.encode(F.coalesce(F.col("label").cast("string"), F.lit("")), "UTF-8"))
        table = shared_path(spark, "images", outlives=True)
        for number in range(groups):
            with lifetime(spark):
                some = members.where(F.col("group") == number).drop("group")
                landing = shared_path(spark, "landing")
                content = read_ranges(some.withColumn("prefix", F.concat_ws("-", text, "copies")))
                landed = land_members(content, landing, prefix="prefix")
                landed.write.format("noop").mode("overwrite").save()
                parts = F.split("filename", "-", 4)
                image = read_images(spark, landing, height, width).withColumn("parts", parts)
                label = F.decode(F.unhex(F.element_at("parts", 2)), "UTF-8")
                rows = image.select(F.element_at("parts", 4).alias("filename"), F.when(label != "", label).cast(kind).alias("label"), "data",
                                    F.explode(F.sequence(F.lit(1), F.element_at("parts", 3).cast("int"))).alias("copy"))
                # Spark's reader counts 4 MB for a file: small images would be a few to a task.
                rows.drop("copy").coalesce(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)).write.mode("append").parquet(table)
        images = spark.read.parquet(table)
        counts = dropped_count(found, images)
        return images, spark.createDataFrame(counts.collect(), counts.schema)  # one row, counted while the index is there


def dropped_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a filter dropped, as one row."""
    counts = before.agg(F.count(F.lit(1)).alias("read")).withColumn(
        "kept", after.agg(F.count(F.lit(1))).scalar())
    return counts.select("read", "kept", (F.col("read") - F.col("kept")).alias("dropped"))
