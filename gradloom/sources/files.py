"""File listings and byte ranges.

Readers here first list files without opening them, cut them into byte ranges, and let each task read its own
ranges. A file that holds most of the data is so read by many tasks, and no file has to fit into one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradloom.functions.shapes import indexed
from gradloom.session import shuffle_partitions

#: Bytes that one row of a ranged read may carry.
RANGE_BYTES = 16 << 20
#: Bytes after which a task hands on the small contents it has gathered.
BATCH_BYTES = 4 << 20


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime) of the files under `path`; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def require_files(spark: SparkSession, directory: str, names: Sequence[str]) -> None:
    """Fail unless `directory` is a folder that holds every named file."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop_path):
        raise FileNotFoundError(f"the path {directory} does not exist")
    if not files.getFileStatus(hadoop_path).isDirectory():
        raise NotADirectoryError(f"the path {directory} is not a directory")
    expected = spark.createDataFrame([(name,) for name in names], "name string")
    found = list_files(spark, directory).select(basename("path").alias("name"))
    missing = sorted(row["name"] for row in expected.join(found, "name", "left_anti").collect())
    if missing:
        raise FileNotFoundError(f"{directory} lacks {', '.join(missing)}")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The Arrow file system and inner path of a Spark path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    scheme, colon, rest = path.partition("://")
    if scheme in ("s3a", "s3n"):
        path = f"s3{colon}{rest}"
    return pyarrow.fs.FileSystem.from_uri(path)


def open_path(path: str) -> pa.NativeFile:
    """Open a Spark path inside a task."""
    files, name = file_system(path)
    return files.open_input_file(name)


def whole_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, first_record, content): every file as one chunk, read by Spark.

    For stores that only Spark can open; a file must stay below 2 GB and is handled by one task.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.lit(0).cast("bigint").alias("first_record"), "content")


def with_content(rows: pa.RecordBatch, contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(contents, pa.binary())], [*rows.schema.names, "content"])


def read_ranges(ranges: DataFrame, num_parts: int | None = None) -> DataFrame:
    """Append `content`, the bytes [offset, offset + size) of `path`, to every row.

    Rows are spread by (path, offset), so ranges of one large file land in different tasks.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened: dict[str, pa.NativeFile] = {}
            held, first, held_bytes = [], 0, 0
            for row, (path, offset, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")))):
                if path not in opened:
                    opened = {path: open_path(path)}
                held.append(opened[path].read_at(size, offset))
                if len(held[-1]) != size:
                    raise EOFError(f"{path} ends before byte {offset + size}")
                held_bytes += size
                if held_bytes >= BATCH_BYTES or row == batch.num_rows - 1:
                    yield with_content(batch.slice(first, len(held)), held)
                    held, first, held_bytes = [], row + 1, 0

    spread = ranges.repartition(num_parts or shuffle_partitions(ranges.sparkSession), "path", "offset")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", content binary"
    return spread.mapInArrow(read, schema)


def record_ranges(files: DataFrame, record_bytes: int, header_bytes: int = 0,
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Cut files of fixed-length records into (path, offset, size, first_record); `files` has path and length."""
    per_range = max(1, range_bytes // record_bytes)
    body = F.col("length") - header_bytes
    checked = F.when(body % record_bytes == 0, F.floor(body / record_bytes)).otherwise(F.raise_error(
        F.concat(F.col("path"), F.lit(f" is not a whole number of {record_bytes}-byte records"))).cast("bigint"))
    cut = files.withColumn("records", checked).filter("records > 0")
    firsts = F.sequence(F.lit(0).cast("bigint"), F.col("records") - 1, F.lit(per_range).cast("bigint"))
    cut = cut.select("path", "records", F.explode(firsts).alias("first_record"))
    size = F.least(F.lit(per_range), F.col("records") - F.col("first_record")) * record_bytes
    return cut.select("path", (F.col("first_record") * record_bytes + header_bytes).alias("offset"),
                      size.cast("bigint").alias("size"), "first_record")


def split_records(chunks: DataFrame, record_bytes: int) -> DataFrame:
    """One row per record: (path, record_index, record). `chunks` has path, first_record and content."""
    length = F.length("content")
    count = F.when(length % record_bytes == 0, F.floor(length / record_bytes)).otherwise(F.raise_error(F.concat(
        F.col("path"), F.lit(f" is not a whole number of {record_bytes}-byte records")))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1),
                         lambda i: F.substring(F.col("content"), i * record_bytes + 1, F.lit(record_bytes)))
    return (indexed(chunks.filter(F.length("content") > 0), ["path", "first_record"], pieces, "at", "record")
            .select("path", (F.col("first_record") + F.col("at")).alias("record_index"), "record"))
