"""Shuffled chunks of samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gradloom.operators.numbering import hash_bucket, number_rows
from gradloom.session import shuffle_partitions


def assign_chunks(df: DataFrame, n_chunks: int, order: Column, bucket: Column) -> DataFrame:
    """Deal rows round robin over `n_chunks` in the given order: columns `position` and `chunk`."""
    numbered = number_rows(df, [], order, bucket, "position")
    return numbered.withColumn("chunk", F.pmod("position", F.lit(n_chunks)).cast("int"))


def chunk_name(prefix: str, chunk: Column, digits: int) -> Column:
    """`prefix.00042`"""
    return F.concat(F.lit(prefix + "."), F.lpad(chunk.cast("string"), digits, "0"))


def chunk_bounds(keys: DataFrame, n_chunks: int) -> list[int] | None:
    """The least key of every chunk after the first, when the keys in order are cut into chunks of equal size (the first ones hold one
    row more). None if equal keys meet at a cut, so that keys alone cannot tell the rows apart.

    `keys` has one column of 64-bit hashes. The driver sees the sizes of a fixed number of hash ranges and one row per chunk.
    """
    keys = keys.toDF("key")
    bits = math.ceil(math.log2(8 * n_chunks + 4 * shuffle_partitions(keys.sparkSession)))
    bucket = hash_bucket(F.col("key"), bits)
    sizes = sorted(keys.groupBy(bucket.alias("bucket")).count().collect())
    total = sum(n for _, n in sizes)
    cuts = [c * (total // n_chunks) + min(c, total % n_chunks) for c in range(1, n_chunks)]
    wanted, ahead, at = [], 0, 0
    for number, n in sizes:
        while at < len(cuts) and cuts[at] < ahead + n:
            wanted.append((at, number, cuts[at] - ahead + 1))
            at += 1
        ahead += n
    if not wanted:
        return [(1 << 63) - 1] * (n_chunks - 1)
    picked = F.broadcast(keys.sparkSession.createDataFrame(wanted, "chunk int, bucket long, rank int"))  # one row per chunk
    inside = Window.partitionBy("bucket").orderBy("key")
    near = keys.withColumn("bucket", bucket).join(picked.select("bucket").distinct(), "bucket", "left_semi")
    ranked = near.withColumns({"rank": F.row_number().over(inside), "before": F.lag("key").over(inside)})
    found = {r["chunk"]: r for r in ranked.join(picked, ["bucket", "rank"]).select("chunk", "key", "before").collect()}
    if any(r["key"] == r["before"] for r in found.values()):
        return None
    # Chunks that no row is left for begin after every key.
    return [found[c]["key"] if c in found else (1 << 63) - 1 for c in range(n_chunks - 1)]


def chunk_of(key: Column, bounds: Sequence[int]) -> Column:
    """The chunk of each key; only the keys travel to the Python workers."""
    cuts = np.array(bounds, "i8")

    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(), side="right").astype("i4"))

    return F.arrow_udf(place, T.IntegerType())(key)


def write_shuffled_chunks(df: DataFrame, n_chunks: int, path: str, id_col: str = "sample_id", seed: int = 0,
                          prefix: str = "train", digits: int = 5, files_per_chunk: int = 1) -> None:
    """Shuffle the rows, deal them into `n_chunks` chunks, write one folder per chunk.

    A row's chunk follows from its id's hash alone: the hashes in order, cut into n equal runs, and dealt from the runs by turns, are
    the shuffled order that is dealt round robin. So rows are shuffled once, to their chunk. Only if one id stands
    in more rows than a cut can keep together, rows are numbered first, which shuffles them twice.
    `files_per_chunk` splits a chunk over several tasks when a whole one is too much for one.
    """
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    order = fresh_name(df, "key")
    bounds = chunk_bounds(df.select(key), n_chunks)
    if bounds is None:
        bits = math.ceil(math.log2(shuffle_partitions(df.sparkSession)))
        dealt = assign_chunks(df, n_chunks, key, hash_bucket(key, bits)).withColumnRenamed("position", order)
        share = F.floor(F.col(order) / n_chunks)
    else:
        dealt = df.withColumn(order, key).withColumn("chunk", chunk_of(F.col(order), bounds))
        share = F.xxhash64(order)
    target = F.col("chunk") * files_per_chunk + F.pmod(share, F.lit(files_per_chunk))
    (dealt.withColumn("part", target.cast("int"))
     .repartitionById(n_chunks * files_per_chunk, "part")
     .sortWithinPartitions("chunk", order)
     .withColumn("chunk", chunk_name(prefix, F.col("chunk"), digits))
     .drop("part", order)
     .write.partitionBy("chunk").parquet(path))


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name
