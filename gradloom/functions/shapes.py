"""Plan-time arithmetic on constant shapes (row-major)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def volume(shape: Sequence[int]) -> int:
    return math.prod(shape)


def strides(shape: Sequence[int]) -> list[int]:
    return [volume(shape[axis + 1:]) for axis in range(len(shape))]


def flat_index(shape: Sequence[int], index: Sequence[int]) -> int:
    if len(index) != len(shape):
        raise ValueError(f"index {tuple(index)} does not fit shape {tuple(shape)}")
    for at, extent in zip(index, shape):
        if not 0 <= at < extent:
            raise IndexError(f"index {tuple(index)} is outside shape {tuple(shape)}")
    return sum(at * step for at, step in zip(index, strides(shape)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`.

    An expression repeated inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indexed(df: DataFrame, keys: Sequence[str | Column], array: Column, position: str, element: str) -> DataFrame:
    """One row per element of `array`: keys, position, element.

    A plain generator makes the optimizer test the array for null and size first, which evaluates a computed array
    three times; an outer generator does not.
    """
    exploded = df.select(*keys, F.posexplode_outer(array).alias(position, element))
    return exploded.filter(F.col(position).isNotNull())


def counting(n: int) -> Column:
    """`[0, ..., n - 1]`, for n >= 1."""
    return F.sequence(F.lit(0), F.lit(n - 1))


def sized(v: Column, n: int, what: str = "value") -> Column:
    """`v`, failing when it does not hold exactly `n` elements."""
    message = F.concat(F.lit(f"{what}: expected {n} elements, found "), F.size(v).cast("string"))
    return F.when(v.isNull() | (F.size(v) == n), v).otherwise(F.raise_error(message))
