"""N-dimensional array functions on flat array columns.

The shape is a constant of the table and so an argument, not a column. All functions stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from gradloom.functions.shapes import counting, flat_index, let, sized, strides, volume


def nd_array(v: Column, shape: Sequence[int]) -> Column:
    """`v` checked against its declared shape."""
    return sized(v, volume(shape), "array")


def nd_zeros(shape: Sequence[int], dtype: str = "float") -> Column:
    return F.array_repeat(F.lit(0).cast(dtype), volume(shape))


def nd_get(v: Column, shape: Sequence[int], index: Sequence[int]) -> Column:
    return F.get(v, F.lit(flat_index(shape, index)))


def nd_set(v: Column, shape: Sequence[int], index: Sequence[int], value) -> Column:
    target = flat_index(shape, index)
    value = value if isinstance(value, Column) else F.lit(value)
    return F.transform(v, lambda x, i: F.when(i == target, value).otherwise(x))


def nd_box(v: Column, shape: Sequence[int], low: Sequence[int | Column], extent: Sequence[int]) -> Column:
    """The box of constant `extent` whose lower corner may differ per row.

    Trailing axes that are taken whole join one contiguous run, so the row is copied run by run, not value by value.
    """
    return let(v, lambda once: _box(once, shape, low, extent))


def _box(v: Column, shape: Sequence[int], low: Sequence[int | Column], extent: Sequence[int]) -> Column:
    steps = strides(shape)
    whole = len(shape)
    while whole > 0 and extent[whole - 1] == shape[whole - 1]:
        whole -= 1
    outer = list(range(max(whole - 1, 0)))
    run = volume(extent[max(whole - 1, 0):])
    corner = F.lit(0)
    for axis in range(whole):
        corner = corner + low[axis] * F.lit(steps[axis])
    if not outer:
        return F.slice(v, corner + 1, F.lit(run))
    runs = counting(volume([extent[axis] for axis in outer]))

    def offset(first: Column, r: Column) -> Column:
        for axis in outer:
            inner = volume([extent[a] for a in outer if a > axis])
            first = first + F.floor(r / inner).cast("int") % extent[axis] * steps[axis]
        return first

    if run == 1:
        return let(corner, lambda c: F.transform(runs, lambda r: F.get(v, offset(c, r))))
    return F.flatten(let(corner, lambda c: F.transform(runs, lambda r: F.slice(v, offset(c, r) + 1, F.lit(run)))))


def nd_subarray(v: Column, shape: Sequence[int], low: Sequence[int], high: Sequence[int]) -> Column:
    """The half-open box `low <= index < high`."""
    if not len(shape) == len(low) == len(high):
        raise ValueError("shape, low and high differ in length")
    for lo, hi, extent in zip(low, high, shape):
        if not 0 <= lo < hi <= extent:
            raise IndexError(f"box {tuple(low)}..{tuple(high)} is outside shape {tuple(shape)}")
    return nd_box(v, shape, low, [hi - lo for lo, hi in zip(low, high)])


def nd_slice(v: Column, shape: Sequence[int], axis: int, index: int) -> Column:
    """Fix one axis; the result has the shape without that axis."""
    low = [0] * len(shape)
    high = list(shape)
    low[axis], high[axis] = index, index + 1
    return nd_subarray(v, shape, low, high)


def without_axis(shape: Sequence[int], axis: int) -> tuple[int, ...]:
    return tuple(extent for at, extent in enumerate(shape) if at != axis)


def nd_flatten(v: Column, shape: Sequence[int]) -> tuple[Column, tuple[int]]:
    """Columns are flat already: the values stay, only the shape changes."""
    return v, (volume(shape),)


def _elementwise(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, op)).otherwise(F.raise_error(F.lit("arrays differ in size")))


def nd_add(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def nd_subtract(a: Column, b: Column) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def nd_scalar_divide(v: Column, divisor) -> Column:
    divisor = divisor if isinstance(divisor, Column) else F.lit(divisor)
    return F.transform(v, lambda x: x / divisor)


def nd_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Equal sizes and every difference within `tolerance`; NaN and null are never equal to anything."""
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= F.lit(tolerance))
    return F.coalesce((F.size(a) == F.size(b)) & close, F.lit(False))
