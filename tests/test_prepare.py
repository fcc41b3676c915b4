import numpy as np
import pytest
from pyspark.sql import functions as F

from gradloom.functions.convert import to_float_vector, to_typed, unsigned_bytes, unsigned_bytes_native
from gradloom.functions.image import (crop_centred, crop_chw, crop_corner, crop_hwc, prepare_hwc, random_crop, rescale,
                                      resize_pixels, subtract_mean, to_planar_rgb)
from gradloom.operators.means import mean_by_position, mean_image, mean_vector
from gradloom.operators.samples import apply_null_policy, null_counts, with_scalar

IMAGE = bytes(range(60))


@pytest.mark.parametrize("kind", ["int", "float", "double", "bigint"])
def test_scalars_become_vectors(spark, kind):
    df = spark.createDataFrame([(1,)], "x int").select(F.col("x").cast(kind))
    assert df.select(to_float_vector(df, "x").alias("v")).first()["v"] == [1.0]


@pytest.mark.parametrize("kind,value", [("array<float>", [0.0, 1.0, 2.0]), ("binary", b"\0\1\2"), ("array<int>", [0, 1, 2])])
def test_arrays_become_vectors(spark, kind, value):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    assert df.select(to_float_vector(df, "x", (1, 3)).alias("v")).first()["v"] == [0, 1, 2]
    with pytest.raises(Exception, match="expected 4 elements, found 3"):
        df.select(to_float_vector(df, "x", (4,)).alias("v")).first()


def test_unsupported_type_fails_before_the_job(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(TypeError):
        to_float_vector(df, "x")
    with pytest.raises(TypeError):
        to_typed(df, "x", "float")


def test_bytes_are_unsigned_unless_typed(spark):
    raw = bytes(range(256))
    df = spark.createDataFrame([(raw,), (b"",), (None,)], "x binary").coalesce(1)
    for convert in (unsigned_bytes, unsigned_bytes_native):
        found = [r["v"] for r in df.select(convert(F.col("x")).alias("v")).collect()]
        assert found[0] == list(range(256)) and found[1] == [] and found[2] is None
    signed = df.limit(1).select(to_typed(df, "x", "byte").alias("v")).first()["v"]
    assert signed == list(range(128)) + list(range(-128, 0))


def test_typed_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    assert df.select(to_typed(df, "x", "long", (2,), truncate=True).alias("v")).first()["v"] == [1, 2]
    with pytest.raises(Exception, match="expected 2 elements, found 3"):
        df.select(to_typed(df, "x", "long", (2,)).alias("v")).first()
    with pytest.raises(Exception, match="expected 4 elements, found 3"):
        df.select(to_typed(df, "x", "long", (4,), truncate=True).alias("v")).first()


def test_subtract_mean(spark):
    df = spark.createDataFrame([(IMAGE,)], "x binary").withColumn("mean", F.expr("transform(sequence(0, 59), i -> float(i))"))
    vector = subtract_mean(to_float_vector(df, "x", (3, 4, 5)), F.col("mean"))
    assert df.select(vector.alias("v")).first()["v"] == [0.0] * 60


def test_random_crop_of_bytes(spark):
    df = spark.range(64).select("id", F.lit(IMAGE).alias("x"))
    rows = df.select(random_crop(to_float_vector(df, "x", (3, 4, 5)), (3, 4, 5), (2, 4), F.col("id")).alias("v")).collect()
    offsets = [0, 1, 2, 3, 5, 6, 7, 8, 20, 21, 22, 23, 25, 26, 27, 28, 40, 41, 42, 43, 45, 46, 47, 48]
    corners = {r["v"][0] for r in rows}
    assert corners == {0, 1, 5, 6, 10, 11}
    assert all([x - r["v"][0] for x in r["v"]] == offsets for r in rows)


def test_crop_corners_repeat_and_change_by_round(spark):
    def corners(round_no, parts):
        df = spark.range(200).repartition(parts)
        row, col = crop_corner(F.col("id"), (3, 10, 10), (4, 4), round_no, 5)
        return {r["id"]: (r["r"], r["c"]) for r in df.select("id", row.alias("r"), col.alias("c")).collect()}

    assert corners(1, 3) == corners(1, 7) != corners(2, 3)
    assert {x for pair in corners(1, 3).values() for x in pair} == set(range(7))


def test_crops_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    image, mean = rng.integers(0, 256, (3, 6, 7), "u1"), rng.normal(100, 5, (3, 6, 7)).astype("f4")
    df = spark.createDataFrame([(image.tobytes(), mean.reshape(-1).tolist(), 2, 1)], "x binary, mean array<float>, r int, c int")
    centred = image.astype("f4") - mean
    expected = centred[:, 2:5, 1:5]
    vector = subtract_mean(unsigned_bytes(F.col("x")), F.col("mean"))
    row = df.select(crop_chw(vector, (3, 6, 7), (3, 4), F.col("r"), F.col("c")).alias("native"),
                    crop_centred(F.col("x"), mean, (3, 6, 7), (3, 4), F.col("r"), F.col("c")).alias("batched"),
                    prepare_hwc(unsigned_bytes(F.col("x")), F.col("mean"), (3, 6, 7), (3, 4), F.col("r"), F.col("c")).alias("hwc")).first()
    assert np.allclose(row["native"], expected.reshape(-1), atol=1e-4)
    assert np.allclose(row["batched"], expected.reshape(-1), atol=1e-4)
    assert np.allclose(row["hwc"], expected.transpose(1, 2, 0).reshape(-1), atol=1e-4)


def test_crop_hwc_keeps_channels_together(spark):
    df = spark.createDataFrame([([float(x) for x in range(18)],)], "x array<float>")
    assert df.select(crop_hwc(F.col("x"), (3, 3, 2), (2, 1), 1, 2).alias("v")).first()["v"] == [10, 11, 16, 17]


def test_rescale(spark):
    df = spark.createDataFrame([([0, 127, 128, 255],)], "x array<int>")
    assert df.select(rescale(F.col("x")).alias("v")).first()["v"] == pytest.approx([-0.5, 127 / 255 - 0.5, 128 / 255 - 0.5, 0.5])
    assert df.select(rescale(F.col("x"), signed=True).alias("v")).first()["v"] == pytest.approx(
        [-0.5, 127 / 255 - 0.5, -128 / 255 - 0.5, -1 / 255 - 0.5])


def test_planes_of_gray_colour_and_alpha(spark):
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [(("a", 1, 2, 3, 16, bytes([1, 2, 3, 4, 5, 6])),), (("b", 1, 2, 1, 0, bytes([7, 8])),),
            (("c", 1, 1, 4, 24, bytes([1, 2, 3, 9])),), (None,)]
    df = spark.createDataFrame(rows, schema).coalesce(1)
    found = [r["v"] and list(r["v"]) for r in df.select(to_planar_rgb(F.col("image")).alias("v")).collect()]
    assert found == [[3, 6, 2, 5, 1, 4], [7, 8, 7, 8, 7, 8], [3, 2, 1], None]


def test_resize():
    image = np.arange(3 * 4 * 6, dtype="u1").reshape(3, 4, 6)
    small = resize_pixels(image, 2, 3)
    assert (small == np.floor(image.reshape(3, 2, 2, 3, 2).mean(axis=(2, 4)) + 0.5)).all()
    assert (resize_pixels(image, 4, 6) == image).all()
    flat = np.full((3, 5, 7), 9, "u1")
    assert (resize_pixels(flat, 11, 3) == 9).all() and resize_pixels(flat, 11, 3).shape == (3, 11, 3)


def test_means_agree(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, (50, 12), "u1")
    df = spark.createDataFrame([(r.tobytes(), [int(x) for x in r]) for r in data], "b binary, a array<int>").repartition(3)
    expected = data.mean(axis=0)
    assert np.array_equal(mean_image(df, "b", (3, 4)).first()["mean"], expected)
    assert np.array_equal([r["mean"] for r in mean_by_position(df, "a").orderBy("pos").collect()], expected)
    doubles = df.select(F.col("a").cast("array<double>").alias("a"))
    assert np.allclose(mean_vector(doubles, "a").first()["mean"], expected, atol=1e-12)


def test_null_policy(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "id int, data array<float>")
    assert [r["id"] for r in apply_null_policy(df, ["data"], "drop").collect()] == [2]
    assert null_counts(df, ["id", "data"]).first() == (0, 1)
    with pytest.raises(Exception, match="column data is null"):
        apply_null_policy(df, ["data"]).collect()


def test_with_scalar_needs_no_join(spark):
    df = with_scalar(spark.range(3), "n", spark.range(7).agg(F.count("*")))
    assert {r["n"] for r in df.collect()} == {7}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
