"""IDX image and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradloom.functions.convert import big_endian_int, byte_at, unsigned_bytes
from gradloom.functions.shapes import indexed
from gradloom.sources.files import RANGE_BYTES, basename, list_files, read_ranges, split_records

# The magic numbers of the format (unsigned bytes in three and in one dimension).
IMAGE_MAGIC = 2051
LABEL_MAGIC = 2049


def idx_header(header: Column, dims: int, magic: int) -> Column:
    """The extents in a header, failing on another magic number."""
    extents = F.array(*[big_endian_int(header, 4 + 4 * d) for d in range(dims)])
    found = big_endian_int(header, 0)
    return F.when(found == magic, extents).otherwise(
        F.raise_error(F.concat(F.lit(f"IDX magic {magic} expected, found "), found.cast("string"))))


def _chunks(spark: SparkSession, path: str, dims: int, magic: int) -> DataFrame:
    header_bytes = 4 + 4 * dims
    files = list_files(spark, path).select("path", "length", F.lit(0).cast("bigint").alias("offset"),
                                           F.lit(header_bytes).cast("bigint").alias("size"))
    heads = read_ranges(files).withColumn("extents", idx_header(F.col("content"), dims, magic))
    record = F.lit(1).cast("bigint")
    for d in range(1, dims):
        record = record * F.col("extents")[d]
    heads = heads.select("path", "length", record.alias("record_bytes"), F.col("extents")[0].alias("records"))
    expected = F.col("records") * F.col("record_bytes") + header_bytes
    heads = heads.withColumn("records", F.when(F.col("length") == expected, F.col("records")).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(": length does not match its header"))).cast("bigint")))
    per_range = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(RANGE_BYTES) / F.col("record_bytes")))
    cut = heads.filter("records > 0").withColumn("per_range", per_range).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.col("per_range"))).alias("first_record"))
    count = F.least(F.col("per_range"), F.col("records") - F.col("first_record"))
    return read_ranges(cut.select(
        "path", "record_bytes", "first_record",
        (F.col("first_record") * F.col("record_bytes") + header_bytes).alias("offset"),
        (count * F.col("record_bytes")).alias("size")))


def decode_idx_images(chunks: DataFrame, raw: bool = False) -> DataFrame:
    """(path, record_index, data) from headerless chunks that carry their `record_bytes`; `raw` keeps bytes."""
    count = F.floor(F.length("content") / F.col("record_bytes")).cast("int")
    size = F.col("record_bytes").cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1),
                         lambda i: F.substring(F.col("content"), i * size + 1, size))
    return (indexed(chunks, ["path", "first_record"], pieces, "at", "record")
            .select("path", (F.col("first_record") + F.col("at")).alias("record_index"),
                    (F.col("record") if raw else unsigned_bytes(F.col("record"))).alias("data")))


def decode_idx_labels(chunks: DataFrame) -> DataFrame:
    """(path, record_index, label) from headerless chunks of one-byte labels."""
    return split_records(chunks, 1).select(
        "path", "record_index", byte_at(F.col("record"), F.lit(0)).cast("bigint").alias("label"))


def read_idx_images(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """Images of an IDX3 file; count and extents come from its header."""
    return decode_idx_images(_chunks(spark, path, 3, IMAGE_MAGIC), raw)


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of an IDX1 file as `bigint`."""
    return decode_idx_labels(_chunks(spark, path, 1, LABEL_MAGIC))


# How the data set's files are named, apart from the split.
KIND_IN_NAME = "(images|labels)([-.]idx[0-9]-ubyte)?"


def split_name(path: Column) -> Column:
    """What an image file and its label file have in common: the name without its kind."""
    return F.regexp_replace(basename(path), KIND_IN_NAME, "")


def zip_by_index(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, sample_id, data, label): images and labels of the same split and record number.

    A record on one side only fails the job. `sample_id` is the record number, unique within a split.
    """
    left = images.select(split_name(F.col("path")).alias("split"), "record_index", "data", F.lit(True).alias("__image"))
    right = labels.select(split_name(F.col("path")).alias("split"), "record_index", "label", F.lit(True).alias("__label"))
    joined = left.join(right, ["split", "record_index"], "full")
    lost = F.raise_error(F.concat(F.lit("no image or no label for record "), F.col("record_index").cast("string"), F.lit(" of "), F.col("split")))
    both = F.when(F.col("__image") & F.col("__label"), F.col("record_index")).otherwise(lost.cast("bigint"))
    return joined.select("split", both.alias("sample_id"), "data", "label")
