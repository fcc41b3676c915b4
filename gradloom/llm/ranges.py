"""Work on sorted rows without a group in one task: range partitions, neighbours, prefix sums.

A range partition splits even a key that holds a third of all rows, since the sort goes on with other columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from gradloom.session import shuffle_partitions, stored


def sorted_parts(df: DataFrame, columns: Sequence[str], part: str = "part") -> DataFrame:
    """Rows in range partitions, sorted; `part` numbers the partitions in order."""
    return (df.repartitionByRange(shuffle_partitions(df.sparkSession), *columns).sortWithinPartitions(*columns)
            .withColumn(part, F.spark_partition_id()))


def prefix_sums(df: DataFrame, key: str, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """Add the sum of `value` over the rows of the same key that come before a row in the order (nulls of `key` are one key).

    One range sort of the rows; then sums by (key, part), of which there are at most keys + partitions, give each part its
    offset, and a window inside (key, part) the rest. Rows are written once, so that both steps see the same partitions.
    """
    rows = stored(sorted_parts(df, [key, *order], "part__"), "sorted-rows")
    sums = rows.groupBy(key, "part__").agg(F.sum(value).alias("sum__"))
    ahead = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(key).alias("key__"), F.col("part__").alias("at__"), F.coalesce(F.sum("sum__").over(ahead), F.lit(0)).alias("offset__"))
    inside = Window.partitionBy(key, "part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within__", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (within.join(offsets, within[key].eqNullSafe(offsets["key__"]) & (within["part__"] == offsets["at__"]))
            .withColumn(name, F.col("offset__") + F.col("within__")).drop("key__", "at__", "part__", "offset__", "within__"))


NEIGHBOURS = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("key", LongType()),
                         StructField("edge", LongType()), StructField("twin", BooleanType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, part) in order. Gives (first, id) and (previous, id) of equal keys, and the first and last row as edges."""
    last = None  # (key, id, first id of its run)
    part = None
    for batch in batches:
        key, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id"))
        if not len(key):
            continue
        fresh = part is None
        part = batch.column("part")[0].as_py()
        previous_key = np.concatenate([[key[0] if last is None else last[0]], key[:-1]])
        previous_id = np.concatenate([[row[0] if last is None else last[1]], row[:-1]])
        begins = key != previous_key
        if last is None:
            begins[0] = True
        run = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        first = np.where(run >= 0, row[np.maximum(run, 0)], last[2] if last else -1)
        same = np.flatnonzero(~begins)
        a = np.concatenate([previous_id[same], first[same]])
        b, k = np.concatenate([row[same], row[same]]), np.concatenate([key[same], key[same]])
        edge = np.full(len(a), -1, np.int64)
        if fresh:
            a, b, k, edge = (np.append(x, y) for x, y in ((a, row[0]), (b, row[0]), (k, key[0]), (edge, 2 * part)))
        last = (key[-1], row[-1], first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, k, edge)] + [pa.array(edge < 0)], names=NEIGHBOURS.names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(last[1]), int(last[1]), int(last[0]), 2 * part + 1)] + [pa.array([False])], names=NEIGHBOURS.names)


def neighbours(df: DataFrame, key: str, row: str, order: Sequence[str] = ()) -> DataFrame:
    """Pairs (key, a, b) of rows that follow each other in their key's sorted run, and of each row with the first of its run.

    Every run of n rows gives at most 2n pairs that connect it. A run over several partitions is joined by the partitions'
    first and last rows, two by partition.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(row).cast("long").alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ordered = sorted_parts(rows, ["key", *[f"o{i}" for i in range(len(order))], "id"])
    found = stored(ordered.select("key", "id", F.col("part").cast("long").alias("part")).mapInArrow(_compare, NEIGHBOURS), "neighbours")
    inside = found.where("twin").select("key", "a", "b")
    before = Window.partitionBy("key").orderBy("edge")
    across = (found.where("NOT twin").select("key", F.lag("a").over(before).alias("a"), "b", F.lag("edge").over(before).alias("was"), "edge")
              .where("a IS NOT NULL AND was % 2 = 1 AND edge % 2 = 0").select("key", "a", "b"))
    return inside.unionByName(across).where("a <> b").distinct()


def first_by_hash(df: DataFrame, n: int, most: int, column: str = "h") -> DataFrame:
    """The `most` rows of the least 64-bit hash in `column`, of n rows. Only about that many leave their tasks, however many tasks there are."""
    share = min(1.0, 1.2 * most / max(n, 1))
    limit = min(int(-(1 << 63) + share * (1 << 64)), (1 << 63) - 1)
    return df.where(F.col(column) <= limit).orderBy(column).limit(most)
