"""Tar archives of images.

An archive is first indexed: its headers are read, its members skipped. Members are then read by byte range, spread
over all tasks, so one huge archive does not hold up the job and none has to fit into memory.
"""

from __future__ import annotations

import io
import itertools
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradloom.operators.joins import gather
from gradloom.session import shuffle_partitions
from gradloom.sources.files import BATCH_BYTES, basename, file_system, list_files, open_path, read_ranges, whole_files

INDEX_SCHEMA = "path string, parent string, member string, offset bigint, size bigint"


def list_archives(spark: SparkSession, path: str, num_parts: int | None = None, glob: str | None = None) -> DataFrame:
    """All archives below `path`, one partition each unless `num_parts` is given."""
    found = list_files(spark, path, glob, recursive=True)
    return found.repartition(num_parts or max(1, found.count()))


def _headers(path: str, parent: str, start: int) -> Iterator[tuple[str, str, str, int, int]]:
    """One archive's regular files, header by header; nothing is remembered between headers."""
    with open_path(path) as file:
        file.seek(start)
        with tarfile.open(fileobj=file, mode="r:") as archive:
            while (entry := archive.next()) is not None:
                if entry.isfile():
                    yield path, parent, entry.name, entry.offset_data, entry.size
                archive.members = []


def index_tar(archives: DataFrame) -> DataFrame:
    """(path, parent, member, offset, size) of every regular file in every archive.

    An archive is a `path`, or an inner archive that starts at `offset` of it under the name `member`.
    """
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for part in itertools.batched(_headers(row["path"], row["parent"], row["offset"]), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)],
                                                     ["path", "parent", "member", "offset", "size"])

    if "member" in archives.columns:
        starts = archives.select("path", F.col("member").alias("parent"), "offset").repartition(
            shuffle_partitions(archives.sparkSession), "path", "offset")
    else:
        starts = archives.select("path", basename(F.col("path")).alias("parent"), F.lit(0).cast("bigint").alias("offset"))
    return starts.mapInArrow(index, INDEX_SCHEMA)


def attach_index_labels(index: DataFrame, labels: DataFrame, on_missing: str = "drop", label: str = "label") -> DataFrame:
    """(path, parent, member, offset, size, filename, label): the members that have a label, before a byte of them is read.

    Index rows are a few dozen bytes, so the join shuffles no content; a name may stand in many archives and a label of it once.
    A label without member fails, or is dropped (`on_missing`).
    """
    named = index.withColumn("filename", basename(F.col("member")))
    return gather(labels.select("filename", label), named, on_missing=on_missing)


def read_members(index: DataFrame, num_parts: int | None = None) -> DataFrame:
    """(path, parent, member, filename, content) of indexed members."""
    return read_ranges(index, num_parts).select(
        "path", "parent", "member", basename(F.col("member")).alias("filename"), "content")


def read_tar(spark: SparkSession, path: str, num_parts: int | None = None, glob: str | None = None,
             whole: bool = False) -> DataFrame:
    """Every regular file of every archive below `path`. `whole` reads archives through Spark (see `whole_files`)."""
    if whole:
        archives = whole_files(spark, path, glob, recursive=True)
        archives = archives.repartition(num_parts) if num_parts else archives
        members = expand_tar(archives.select("path", "content"))
        return members.select("path", basename(F.col("path")).alias("parent"), "member",
                              basename(F.col("member")).alias("filename"), "content")
    width = num_parts or shuffle_partitions(spark)
    return read_members(index_tar(list_archives(spark, path, width, glob)), width)


def read_nested_tar(spark: SparkSession, path: str, num_parts: int | None = None) -> DataFrame:
    """Every file inside the archives that an archive consists of."""
    width = num_parts or shuffle_partitions(spark)
    return read_members(index_tar(index_tar(list_archives(spark, path, width))), width)


def expand_tar(archives: DataFrame, content: str = "content") -> DataFrame:
    """Members of archives that are already held as bytes; the other columns are kept. Entries leave in small batches."""
    kept = [c for c in archives.columns if c != content]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in archives.schema if f.name != content)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).select(kept)
                names, bodies, held_bytes = [], [], 0
                for name, data in _members(batch.column(content)[row].as_py()):
                    names.append(name)
                    bodies.append(data)
                    held_bytes += len(data)
                    if held_bytes >= BATCH_BYTES:
                        yield emit(one, names, bodies)
                        names, bodies, held_bytes = [], [], 0
                if names:
                    yield emit(one, names, bodies)

    def emit(one: pa.RecordBatch, names: list[str], bodies: list[bytes]) -> pa.RecordBatch:
        repeated = [column.take(pa.array([0] * len(names))) for column in one.columns]
        return pa.RecordBatch.from_arrays([*repeated, pa.array(names), pa.array(bodies, pa.binary())],
                                          [*kept, "member", "content"])

    return archives.mapInArrow(expand, schema + "member string, content binary")


def _members(archive: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r|") as entries:
        for entry in entries:
            if entry.isfile():
                yield entry.name, entries.extractfile(entry).read()


def land_members(members: DataFrame, directory: str, unique_names: bool = False, prefix: str | None = None) -> DataFrame:
    """Write members as single files, for readers that open files only; returns (filename, landed).

    Unless file names are unique, a hash of archive and member goes before them, and after it the column `prefix`. A repeated
    task overwrites its own files with the same bytes.
    """
    name = F.col("filename") if unique_names else F.concat_ws(
        "-", F.hex(F.xxhash64("path", "parent", "member")), *[c for c in (prefix,) if c], "filename")
    named = members.select("filename", "content", name.alias("landed"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(directory)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for row in range(batch.num_rows):
                with files.open_output_stream(f"{root}/{batch.column('landed')[row].as_py()}") as out:
                    out.write(batch.column("content")[row].as_buffer())
            yield batch.select(["filename", "landed"])

    return named.mapInArrow(write, "filename string, landed string")
