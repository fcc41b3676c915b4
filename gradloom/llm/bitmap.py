"""A set of 64-bit hashes as two bitmaps of a fixed size: a first filter before an exact join, never the join itself."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Two maps of 2^24 bits are 4 MB, whatever the input. Full maps let more rows through to the exact join behind them, and lose none.
BITS = 24
_BUCKET = 32768


def build(values: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """One bit for the lowest `bits` bits of the long column, one for the next. Spark merges parts of 4 KB; 2^bits / 4 bytes at most reach the driver."""
    mask = (1 << bits) - 1
    places = F.explode(F.array(*[F.struct(F.lit(m).alias("map"), (F.shiftrightunsigned(column, m * bits).bitwiseAND(F.lit(mask)) + 1).alias("at")) for m in (0, 1)]))
    parts = (values.where(F.col(column).isNotNull()).select(places.alias("x")).select("x.*")
             .groupBy("map", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("part")).collect())
    whole = np.zeros((2, 1 << bits >> 3), np.uint8)
    for m, bucket, part in parts:
        begin = (bucket - 1) * _BUCKET // 8
        whole[m, begin:begin + _BUCKET // 8] = np.frombuffer(bytes(part), np.uint8)
    return values.sparkSession.sparkContext.broadcast(whole)


def contains(maps: np.ndarray, values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether both bits of each value are set; the second is looked up for those that have the first."""
    found = _bit(maps[0], values.astype(np.uint64), bits)
    at = np.flatnonzero(found)
    found[at] = _bit(maps[1], values[at].astype(np.uint64) >> np.uint64(bits), bits)
    return found


def _bit(part: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    at = values & np.uint64((1 << bits) - 1)
    return (part[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
