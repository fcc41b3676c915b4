"""Typed column to flat vector."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradloom.functions.shapes import sized, volume

SCALARS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
TYPED = {"float": "float", "double": "double", "int": "int", "long": "bigint", "byte": "tinyint"}

#: A conversion takes the column, its type and the per-sample shape; users may pass their own.
Conversion = Callable[[Column, T.DataType, Sequence[int]], Column]


def _bytes_as(numpy_type: str, arrow_type: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def convert(values: pa.Array) -> pa.Array:
        values = values.cast(pa.binary())
        _, offsets, data = values.buffers()
        starts = np.frombuffer(offsets, "i4", len(values) + 1, values.offset * 4)
        raw = np.frombuffer(data, "u1", starts[-1])[starts[0]:] if data is not None else np.empty(0, "u1")
        flat = raw.view(numpy_type).astype(arrow_type.to_pandas_dtype())
        mask = values.is_null() if values.null_count else None
        return pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(flat), mask=mask)

    return convert


def unsigned_bytes(col: Column) -> Column:
    """`binary` -> `array<float>` of 0..255; whole Arrow buffers are reinterpreted at once."""
    def unsigned_vector(values: pa.Array) -> pa.Array:
        return _bytes_as("u1", pa.float32())(values)

    return F.arrow_udf(unsigned_vector, T.ArrayType(T.FloatType()))(col)


def signed_bytes(col: Column) -> Column:
    """`binary` -> `array<tinyint>` of -128..127."""
    def signed_vector(values: pa.Array) -> pa.Array:
        return _bytes_as("i1", pa.int8())(values)

    return F.arrow_udf(signed_vector, T.ArrayType(T.ByteType()))(col)


def unsigned_bytes_native(col: Column) -> Column:
    """`binary` -> `array<int>` without leaving the JVM; suits short values."""
    values = F.transform(F.split(F.decode(col, "ISO-8859-1"), ""), lambda c: F.ascii(c))
    return F.when(F.length(col) == 0, F.array().cast("array<int>")).otherwise(values)


def byte_at(col: Column, position) -> Column:
    """The unsigned byte at a 0-based position."""
    return F.conv(F.hex(F.substring(col, position + 1, 1)), 16, 10).cast("int")


def big_endian_int(col: Column, position: int) -> Column:
    """The unsigned 32-bit big-endian number at a 0-based byte position."""
    return F.conv(F.hex(F.substring(col, position + 1, 4)), 16, 10).cast("bigint")


def float_vector(col: Column, data_type: T.DataType, shape: Sequence[int]) -> Column:
    """The default conversion: numbers, numeric arrays and bytes to `array<float>` of exactly the shape's size."""
    if isinstance(data_type, SCALARS):
        vector = F.array(col.cast("float"))
    elif isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, SCALARS):
        vector = col.cast("array<float>")
    elif isinstance(data_type, T.BinaryType):
        vector = unsigned_bytes(col)
    else:
        raise TypeError(f"cannot convert {data_type.simpleString()} to a float vector")
    return sized(vector, volume(shape), "vector")


def to_float_vector(df: DataFrame, name: str, shape: Sequence[int] = (1,)) -> Column:
    """`float_vector` with the type taken from the table, so that a wrong type fails before any job runs."""
    return float_vector(F.col(name), df.schema[name].dataType, shape)


def to_typed(df: DataFrame, name: str, dtype: str, shape: Sequence[int] | None = None,
             truncate: bool = False) -> Column:
    """Keep a declared dtype; bytes stay signed. `truncate` accepts longer inputs and keeps the first values."""
    if dtype not in TYPED:
        raise TypeError(f"unknown dtype {dtype}; use one of {sorted(TYPED)}")
    data_type, target = df.schema[name].dataType, TYPED[dtype]
    if isinstance(data_type, SCALARS):
        if shape is None:
            return F.col(name).cast(target)
        vector = F.array(F.col(name).cast(target))
    elif isinstance(data_type, T.BinaryType):
        vector = signed_bytes(F.col(name)).cast(f"array<{target}>")
    elif isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, SCALARS):
        vector = F.col(name).cast(f"array<{target}>")
    else:
        raise TypeError(f"cannot convert {data_type.simpleString()} to {dtype}")
    if shape is None:
        return vector
    n = volume(shape)
    return sized(F.slice(vector, 1, n) if truncate else vector, n, name)
