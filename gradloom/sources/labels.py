"""Label files: lines `path label`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.sources.files import basename


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, order): a line's place is its file, the start of its block and its rank within the block's scan."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("rank")).alias("order"))


def parse_labels(lines: DataFrame) -> DataFrame:
    """(filename, label, lines) with the base name as key; the last line of a repeated key wins.

    `max_by` combines before the shuffle, so a key repeated in a third of the lines is no hot spot.
    """
    words = F.split(F.trim("line"), " ")
    # What stands before the last blank is the path, so that a path may hold blanks itself.
    path = F.rtrim(F.regexp_replace(F.trim("line"), r"[^ ]+$", F.lit("")))
    path = F.when(F.size(words) > 1, path).otherwise(F.element_at(words, 1))
    return (lines.filter(F.length(F.trim("line")) > 0)
            .select(basename(path).alias("filename"), F.element_at(words, -1).cast("int").alias("label"), "order")
            .groupBy("filename")
            .agg(F.max_by("label", "order").alias("label"), F.count(F.lit(1)).alias("lines")))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(label_lines(spark, path)).select("filename", "label")


def duplicate_labels(spark: SparkSession, path: str) -> DataFrame:
    """Keys that occur on several lines."""
    return parse_labels(label_lines(spark, path)).filter("lines > 1")


def publish_labels(df: DataFrame, path: str) -> None:
    """Write (filename, label) as `path label` lines."""
    df.select(F.concat_ws(" ", "filename", F.col("label").cast("string")).alias("value")).write.text(path)
