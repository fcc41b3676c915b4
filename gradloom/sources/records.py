"""Fixed-length labelled records: one unsigned label byte, then unsigned planar pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.functions.convert import byte_at, unsigned_bytes
from gradloom.functions.shapes import sized, volume
from gradloom.sources.files import basename, list_files, read_ranges, record_ranges, require_files, split_records, whole_files

# The file names of the 32x32 image set.
TRAIN_FILES = ["data_batch_1.bin", "data_batch_2.bin", "data_batch_3.bin", "data_batch_4.bin", "data_batch_5.bin"]
TEST_FILE = "test_batch.bin"


def decode_fixed_records(chunks: DataFrame, shape: Sequence[int], test_file: str = TEST_FILE,
                         raw: bool = False) -> DataFrame:
    """Samples from chunks of whole records; `chunks` has path, first_record and content.

    The sample id is a hash of file and record number, so it does not depend on how the files were cut. `raw` keeps the
    pixels as bytes, a quarter of the size, which scoring and training read as well.
    """
    n = volume(shape)
    rows = split_records(chunks, 1 + n)
    pixels = F.substring(F.col("record"), F.lit(2), F.lit(n))
    return rows.select(
        F.xxhash64("path", "record_index").alias("sample_id"),
        "path", "record_index",
        F.when(basename(F.col("path")) == test_file, "test").otherwise("train").alias("split"),
        (pixels if raw else sized(unsigned_bytes(pixels), n, "record")).alias("data"),
        byte_at(F.col("record"), F.lit(0)).alias("label"))


def read_fixed_records(spark: SparkSession, path: str, shape: Sequence[int] = (3, 32, 32), glob: str = "*.bin",
                       required: Sequence[str] | None = None, raw: bool = False, whole: bool = False) -> DataFrame:
    """Records of `1 + volume(shape)` bytes; a file that ends inside a record is an error.

    `whole` reads files through Spark (see `whole_files`).
    """
    if required:
        require_files(spark, path, required)
    if whole:
        return decode_fixed_records(whole_files(spark, path, glob), shape, raw=raw)
    ranges = record_ranges(list_files(spark, path, glob), 1 + volume(shape))
    return decode_fixed_records(read_ranges(ranges), shape, raw=raw)
