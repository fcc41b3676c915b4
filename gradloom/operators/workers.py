"""Assignment of rows to workers, minibatch windows and batches.

A worker is a number in a column, not a process: any task may handle any worker, on any machine, any number of times.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gradloom.operators.numbering import hash_bucket, number_rows
from gradloom.session import stored, tasks_for

#: Segment numbers per worker in a written sample table.
SEGMENTS = 1 << 20


def assign_workers(df: DataFrame, workers: int, id_col: str = "sample_id", seed: int = 0,
                   worker: Column | None = None, order: Column | None = None, bucket: Column | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Columns `worker`, `pos` (0-based within the worker, shuffled) and `worker_rows`.

    Worker and order come from hashes of the sample id, so the shuffle is the same on every run and retry. The id must
    be unique for the hashes to be even; `read_samples` makes one for tables that have none. `buckets`
    is the number of ranges in which a worker's rows are numbered (default: about four per task in all).
    With an own `order`, `bucket` must be given, bounded in rows and not decreasing along it.
    """
    identity = F.col(id_col)
    rows = df.count()
    worker = worker if worker is not None else F.pmod(F.xxhash64(identity), F.lit(workers))
    if order is None:
        order = F.xxhash64(identity, F.lit(seed))
        buckets = buckets or max(1, 4 * tasks_for(df.sparkSession, rows) // workers)
        bucket = hash_bucket(order, math.ceil(math.log2(buckets)))
    elif bucket is None:
        raise ValueError("an own order needs a bucket")
    placed = df.withColumn("worker", worker.cast("int"))
    return number_rows(placed, ["worker"], [order, identity], bucket, "pos", "worker_rows", rows)


def assign_workers_in_place(df: DataFrame, workers: int) -> DataFrame:
    """The variant without a shuffle: merged input partitions are the workers, rows keep their order.

    An input of fewer partitions than workers is an error: repartition it first, or every average would be over fewer
    workers than asked.
    It follows the physical layout of the input, so store the result (`stored`, `write_segments`) before using it twice.
    """
    parts = df.rdd.getNumPartitions()
    if parts < workers:
        raise ValueError(f"{workers} workers in place need as many partitions; the input has {parts}")
    merged = df.coalesce(workers)
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return merged.withColumns({"worker": F.spark_partition_id(), "pos": rank})


def worker_counts(assigned: DataFrame) -> DataFrame:
    """(worker, worker_rows), one row per worker."""
    return assigned.groupBy("worker").agg(F.count(F.lit(1)).alias("worker_rows"))


def round_starts(counts: DataFrame, tau: int, batch: int, round_no: int, seed: int = 0, wrap: bool = False,
                 start: Column | None = None) -> DataFrame:
    """(worker, worker_rows, start): each worker's window of `tau * batch` rows in this round.

    The start is uniform in [0, worker_rows - tau * batch); a worker without more rows than that is an error.
    With `wrap` the window runs on at the worker's first row instead. `start` overrides the draw.
    """
    need = tau * batch
    room = F.col("worker_rows") if wrap else F.col("worker_rows") - need
    draw = F.pmod(F.xxhash64("worker", F.lit(round_no), F.lit(seed)), room)
    draw = (start if start is not None else draw).cast("bigint")
    too_small = F.raise_error(F.concat(F.lit("worker "), F.col("worker").cast("string"), F.lit(" has only "),
                                       F.col("worker_rows").cast("string"), F.lit(f" rows for a window of {need}")))
    return counts.withColumn("start", F.when(room > 0, draw).otherwise(too_small.cast("bigint")))


def round_window(assigned: DataFrame, counts: DataFrame, tau: int, batch: int, round_no: int, seed: int = 0,
                 wrap: bool = False, start: Column | None = None) -> DataFrame:
    """The rows of this round's windows, with `offset` in the window and `batch_id`.

    The broadcast side has one row per worker.
    """
    starts = round_starts(counts, tau, batch, round_no, seed, wrap, start)
    offset = F.col("pos") - F.col("start")
    windowed = assigned.drop("worker_rows").join(F.broadcast(starts), "worker")
    if wrap:
        # A worker with fewer rows than the window goes round as often as it takes.
        first = F.pmod(offset, F.col("worker_rows"))
        again = F.sequence(first, F.greatest(first, F.lit(tau * batch - 1).cast("bigint")), F.col("worker_rows"))
        windowed = windowed.withColumn("offset", F.explode(again))
    else:
        windowed = windowed.withColumn("offset", offset)
    windowed = windowed.filter((F.col("offset") >= 0) & (F.col("offset") < tau * batch))
    return windowed.withColumn("batch_id", batch_id(F.col("offset"), batch)).drop("worker_rows", "start")


def batch_id(position: Column, batch: int) -> Column:
    """Runs of `batch` rows; the last one may be shorter."""
    return F.floor(position / batch)


def skip_rows(assigned: DataFrame, k: int) -> DataFrame:
    """Every worker's rows from position `k` on."""
    return assigned.filter(F.col("pos") >= k)


def segment_of(worker, pos, rows: int):
    return worker * SEGMENTS + F.floor(pos / rows)


def write_segments(assigned: DataFrame, path: str, rows: int, regroup: bool = False) -> None:
    """Write an assigned table in segments of at most `rows` rows of one worker, one folder each.

    A training round then reads the few segments its windows touch instead of scanning every row. An assigned table is
    already clustered by ranges of positions, so it is written without another shuffle; `regroup` shuffles it to one
    file per segment, for tables that have been rearranged since.
    """
    cut = assigned.withColumn("segment", segment_of(F.col("worker").cast("bigint"), F.col("pos"), rows))
    cut = cut.repartition("segment") if regroup else cut
    cut.sortWithinPartitions("segment", "pos").write.partitionBy("segment").parquet(path)


@dataclass(frozen=True)
class Segments:
    """A table written by `write_segments` with `rows` rows per segment; its folders are listed once, when it is opened."""

    table: DataFrame
    rows: int


def open_segments(spark: SparkSession, path: str, rows: int) -> Segments:
    return Segments(spark.read.parquet(path), rows)


def segment_window(segments: Segments, counts: DataFrame, tau: int, batch: int, round_no: int, seed: int = 0,
                   wrap: bool = False, start: Column | None = None) -> DataFrame:
    """`round_window` over written segments: the window starts, one per worker, select the segments to read."""
    rows = segments.rows
    starts = round_starts(counts, tau, batch, round_no, seed, wrap, start).collect()
    touched = set()
    for row in starts:
        first, last, n = row["start"], row["start"] + tau * batch - 1, row["worker_rows"]
        spans = [(first, min(last, n - 1))] + ([(0, min(last - n, n - 1))] if last >= n else [])
        for low, high in spans:
            touched.update(row["worker"] * SEGMENTS + s for s in range(low // rows, high // rows + 1))
    selected = segments.table.filter(F.col("segment").isin(sorted(touched))).drop("segment")
    return round_window(selected, counts, tau, batch, round_no, seed, wrap, start)


#: A row's place in a sample table: worker * SPAN + position.
SPAN = 1 << 40


def write_positions(assigned: DataFrame, path: str, rows: int) -> None:
    """Write an assigned table so that a training round reads its windows only: files sorted by (worker, position), in pages of `rows` rows.

    An assigned table is already clustered by ranges of positions, so it is written without another shuffle, whatever the number of
    workers, and a task writes one file.
    """
    place = F.col("worker").cast("bigint") * SPAN + F.col("pos")
    (assigned.withColumn("place", place).sortWithinPartitions("place")
     .write.option("parquet.page.row.count.limit", str(rows)).parquet(path))


@dataclass(frozen=True)
class SampleFiles:
    """A table written by `write_positions`: its rows, and as a small table which file holds rows of which run of `rows` positions."""

    table: DataFrame
    places: DataFrame
    rows: int


def open_positions(spark: SparkSession, path: str, rows: int) -> SampleFiles:
    """One scan of the place column makes the table of places; it has a row for each run and stays distributed."""
    table = spark.read.parquet(path)
    runs = table.select(segment_number(F.col("place"), rows).alias("run"), F.col("_metadata.file_path").alias("file")).distinct()
    return SampleFiles(table.drop("place"), stored(runs, "places"), rows)


def segment_number(place: Column, rows: int) -> Column:
    """Worker and run of `rows` positions as one number."""
    position = place.bitwiseAND(F.lit(SPAN - 1))
    return place - position + F.floor(position / rows)


def position_window(files: SampleFiles, counts: DataFrame, tau: int, batch: int, round_no: int, seed: int = 0,
                    wrap: bool = False, start: Column | None = None) -> DataFrame:
    """`round_window` over written files: the files that the windows touch are opened, and of these the row groups and pages that hold rows of one.

    The driver sees each worker's window and the files they lie in, a few per worker.
    """
    spark, rows = files.table.sparkSession, files.rows
    spans = []
    for row in round_starts(counts, tau, batch, round_no, seed, wrap, start).collect():
        first, last, n = row["start"], row["start"] + tau * batch - 1, row["worker_rows"]
        parts = [(first, min(last, n - 1))] + ([(0, min(last - n, n - 1))] if last >= n else [])
        spans += [(row["worker"] * SPAN, low, high) for low, high in parts]
    if not spans:
        return round_window(files.table, counts, tau, batch, round_no, seed, wrap, start)
    asked = spark.createDataFrame([(worker, low // rows, high // rows) for worker, low, high in spans], "worker long, low long, high long")
    runs = asked.select(F.explode(F.transform(F.sequence("low", "high"), lambda run: F.col("worker") + run)).alias("run")).distinct()
    found = sorted(r[0] for r in files.places.join(runs, "run", "left_semi").select("file").distinct().collect())
    place = F.col("place")
    inside = any_of([(place >= worker + low) & (place <= worker + high) for worker, low, high in spans])
    selected = spark.read.schema(T.StructType([*files.table.schema.fields, T.StructField("place", T.LongType())])).parquet(*found).where(inside).drop("place")
    return round_window(selected, counts, tau, batch, round_no, seed, wrap, start)


def any_of(conditions: Sequence[Column]) -> Column:
    """Their disjunction as a balanced tree, so that many of them nest no deeper than their logarithm."""
    conditions = list(conditions)
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + (conditions[-1:] if len(conditions) % 2 else [])
    return conditions[0]
