import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradloom.functions.ndarray import (nd_add, nd_array, nd_box, nd_equal, nd_get, nd_scalar_divide, nd_set, nd_slice,
                                        nd_subarray, nd_subtract, nd_zeros, without_axis)

SHAPE = (3, 4, 5)


def value(spark, column, **arrays):
    row = spark.createDataFrame([tuple([float(x) for x in v] for v in arrays.values())],
                                ", ".join(f"{n} array<float>" for n in arrays))
    return row.select(column.alias("x")).first()["x"]


@pytest.fixture()
def raw():
    return np.arange(60, dtype="f4")


def test_get_and_set(spark, raw):
    v = F.col("v")
    assert [value(spark, nd_get(v, SHAPE, i), v=raw) for i in [(0, 0, 0), (1, 2, 3), (2, 3, 4)]] == [0, 33, 59]
    assert value(spark, nd_get(nd_set(v, SHAPE, (1, 2, 3), 5.0), SHAPE, (1, 2, 3)), v=raw) == 5
    with pytest.raises(IndexError):
        nd_get(v, SHAPE, (3, 0, 0))


def test_subarray_and_slices(spark, raw):
    v = F.col("v")
    assert value(spark, nd_subarray(v, SHAPE, (0, 1, 2), (1, 3, 5)), v=raw) == [7, 8, 9, 12, 13, 14]
    assert [without_axis(SHAPE, a) for a in range(3)] == [(4, 5), (3, 5), (3, 4)]
    assert value(spark, nd_slice(nd_slice(v, SHAPE, 0, 1), (4, 5), 1, 2), v=raw) == [22, 27, 32, 37]
    assert value(spark, nd_slice(nd_slice(v, SHAPE, 2, 4), (3, 4), 0, 2), v=raw) == [44, 49, 54, 59]
    assert value(spark, nd_get(nd_slice(v, SHAPE, 2, 3), (3, 4), (1, 2)), v=raw) == 33
    with pytest.raises(IndexError):
        nd_subarray(v, SHAPE, (0, 0, 0), (4, 1, 1))


def test_arithmetic(spark, raw):
    a, b, c, v = (F.col(n) for n in "abcv")
    arrays = dict(a=[1, 2, 3, 4], b=[1, 3, 5, 7], c=[-2, -5, -8, -11])
    total = nd_add(nd_add(a, b), c)
    assert value(spark, total, **arrays) == [0, 0, 0, 0]
    assert value(spark, nd_equal(total, nd_zeros((2, 2)), 0.0), **arrays)
    boxes = nd_add(nd_subarray(v, SHAPE, (0, 0, 0), (1, 2, 3)), nd_subarray(v, SHAPE, (1, 1, 1), (2, 3, 4)))
    assert value(spark, boxes, v=raw) == [26, 28, 30, 36, 38, 40]
    assert value(spark, nd_subtract(a, b), a=[1, 2, 3, 3, 2, 1], b=[1, 3, 5, 5, 3, 1]) == [0, -1, -2, -2, -1, 0]
    assert value(spark, nd_scalar_divide(a, 2.0), a=[1, 2, 3, 4, 5, 6]) == [0.5, 1, 1.5, 2, 2.5, 3]


def test_equality_rules(spark):
    a, b = F.col("a"), F.col("b")
    assert not value(spark, nd_equal(a, b, 1.0), a=[1, 2], b=[1])
    assert not value(spark, nd_equal(a, b, 1.0), a=[float("nan")], b=[0])
    assert value(spark, nd_equal(a, b, 0.5), a=[1, 2], b=[1.5, 1.75])


def test_size_errors(spark):
    with pytest.raises(Exception, match="expected 3 elements, found 2"):
        value(spark, nd_array(F.col("a"), (3,)), a=[1, 2])
    with pytest.raises(Exception, match="differ in size"):
        value(spark, nd_add(F.col("a"), F.col("b")), a=[1, 2], b=[1])


@settings(max_examples=12, deadline=None)
@given(st.data())
def test_box_equals_numpy(spark, data):
    shape = data.draw(st.lists(st.integers(1, 4), min_size=1, max_size=4))
    low = [data.draw(st.integers(0, n - 1)) for n in shape]
    high = [data.draw(st.integers(lo + 1, n)) for lo, n in zip(low, shape)]
    array = np.arange(np.prod(shape), dtype="f4").reshape(shape)
    expected = array[tuple(slice(*s) for s in zip(low, high))].reshape(-1).tolist()
    assert value(spark, nd_subarray(F.col("v"), shape, low, high), v=array.reshape(-1)) == expected
    extent = [h - lo for lo, h in zip(low, high)]
    assert value(spark, nd_box(F.col("v"), shape, [F.lit(x) for x in low], extent), v=array.reshape(-1)) == expected
