"""Image preparation on planar (channel, height, width) arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from gradloom.functions.ndarray import nd_box, nd_subtract
from gradloom.functions.shapes import counting, let, volume
from gradloom.plans.batches import StoredVector, list_column, matrix
from gradloom.plans.net import Prepare


def subtract_mean(v: Column, mean: Column) -> Column:
    """Element-wise `v - mean`. `mean` is an array column, usually a scalar subquery attached by `with_scalar`."""
    return nd_subtract(v, mean)


def rescale(v: Column, signed: bool = False) -> Column:
    """`x / 255 - 0.5` on unsigned pixels. `signed` wraps values of 128 and more to negative ones first."""
    if signed:
        v = F.transform(v, lambda x: F.when(x > 127, x - 256).otherwise(x))
    return F.transform(v, lambda x: x / F.lit(255.0) - F.lit(0.5))


def crop_corner(sample_id: Column, shape: Sequence[int], crop: Sequence[int], round_no: int = 0,
                seed: int = 0) -> tuple[Column, Column]:
    """Uniform row and column of the crop's corner, both ends included.

    The corner comes from a hash of the sample, round and seed, so a retried task crops alike.
    """
    height, width = shape[-2:]
    rows, cols = height - crop[0] + 1, width - crop[1] + 1
    if rows < 1 or cols < 1:
        raise ValueError(f"crop {tuple(crop)} is larger than {tuple(shape)}")
    pick = lambda axis, n: F.pmod(F.xxhash64(sample_id, F.lit(round_no), F.lit(seed), F.lit(axis)), F.lit(n)).cast("int")
    return pick(0, rows), pick(1, cols)


def crop_chw(v: Column, shape: Sequence[int], crop: Sequence[int], row, col) -> Column:
    return nd_box(v, shape, [0, row, col], [shape[0], *crop])


def crop_hwc(v: Column, shape: Sequence[int], crop: Sequence[int], row, col) -> Column:
    """Crop of an interleaved image; `shape` is (height, width, channels)."""
    return nd_box(v, shape, [row, col, 0], [*crop, shape[2]])


def random_crop(v: Column, shape: Sequence[int], crop: Sequence[int], sample_id: Column, round_no: int = 0,
                seed: int = 0) -> Column:
    """A seeded random crop of a planar image with three channels."""
    if len(shape) != 3 or shape[0] != 3:
        raise ValueError(f"random_crop needs shape (3, height, width), got {tuple(shape)}")
    row, col = crop_corner(sample_id, shape, crop, round_no, seed)
    at_once = F.struct(v.alias("v"), row.alias("r"), col.alias("c"))
    return let(at_once, lambda at: crop_chw(at["v"], shape, crop, at["r"], at["c"]))


def to_hwc(v: Column, shape: Sequence[int]) -> Column:
    """Planar to interleaved: output `c + channels * p` is plane `c` at pixel `p`."""
    channels, plane = shape[0], volume(shape[1:])
    return let(v, lambda once: F.transform(counting(volume(shape)), lambda k: F.get(
        once, k % channels * plane + F.floor(k / channels).cast("int"))))


def prepare_hwc(v: Column, mean: Column, shape: Sequence[int], crop: Sequence[int], row, col) -> Column:
    """Subtract the mean, interleave the planes, crop."""
    hwc = (shape[1], shape[2], shape[0])
    return crop_hwc(to_hwc(subtract_mean(v, mean), shape), hwc, crop, row, col)


def crop_pixels(images: np.ndarray, mean: np.ndarray, rows: np.ndarray, cols: np.ndarray, crop: Sequence[int]) -> np.ndarray:
    """Crops of (n, channels, height, width) pixels at each image's corner, minus the mean, as float32."""
    height, width = crop
    out = np.empty((len(images), images.shape[1], height, width), "f4")
    for at, (r, c) in enumerate(zip(rows, cols)):
        window = np.s_[:, r:r + height, c:c + width]
        np.subtract(images[at][window], mean[window], out=out[at], dtype="f4", casting="unsafe")
    return out


def crop_centred(data: Column, mean: np.ndarray, shape: Sequence[int], crop: Sequence[int], row: Column, col: Column) -> Column:
    """Mean subtraction and crop of large `binary` images in one pass over Arrow buffers, as `array<float>`.

    Only the cropped pixels are converted. `mean` has one value per pixel, so its size is fixed by the shape.
    """
    mean = np.asarray(mean, "f4").reshape(shape)

    def cropped(images: pa.Array, rows: pa.Array, cols: pa.Array) -> pa.Array:
        pixels = matrix(images, volume(shape)).reshape(-1, *shape)
        return list_column(crop_pixels(pixels, mean, rows.to_numpy(), cols.to_numpy(), crop), pa.float32())

    return F.arrow_udf(cropped, T.ArrayType(T.FloatType()))(data, row, col)


def crop_preparation(mean: np.ndarray | StoredVector, shape: Sequence[int], crop: Sequence[int], row: str = "crop_row",
                     col: str = "crop_col", interleave: bool = False) -> Prepare:
    """The same inside a scoring or training batch: raw bytes travel to the task, floats never travel at all.

    A stored mean (see `publish_mean`) is read by the tasks and is in no plan or closure.
    """
    mean = mean if isinstance(mean, StoredVector) else np.asarray(mean, "f4")

    def run(pixels: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        centre = mean.load("f4") if isinstance(mean, StoredVector) else mean
        out = crop_pixels(pixels.reshape(-1, *shape), centre.reshape(shape), rows, cols, crop)
        return out.transpose(0, 2, 3, 1) if interleave else out

    return Prepare(volume(shape), (row, col), run)


def round_crop(mean: np.ndarray | StoredVector, shape: Sequence[int], crop: Sequence[int], seed: int = 0, id_col: str = "sample_id",
               corner: Callable[[Column, int], tuple[Column, Column]] | None = None, interleave: bool = False) -> Prepare:
    """Mean subtraction and a crop that is drawn anew in every round, inside the batch.

    The corner is a hash of the sample, the round and the seed, so a retried task crops alike; `corner` gives it
    instead, from the sample's id and the round.
    """
    corner = corner or (lambda sample, round_no: crop_corner(sample, shape, crop, round_no, seed))
    crop_corner(F.col(id_col), shape, crop)  # a crop that is too large fails here
    fixed = crop_preparation(mean, shape, crop, interleave=interleave)
    return replace(fixed, draw=lambda round_no: corner(F.col(id_col), round_no), reads=(id_col,))


def _planar(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, "u1").reshape(height, width, channels)
    pixels = np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]
    return pixels.transpose(2, 0, 1)


@functools.lru_cache(maxsize=64)
def resampling(source: int, target: int) -> np.ndarray:
    """Weights (target, source) along one axis: box average when shrinking, linear interpolation when growing."""
    if target <= source:
        edge = np.arange(target + 1) * source / target
        pixel = np.arange(source)
        overlap = np.minimum(edge[1:, None], pixel + 1) - np.maximum(edge[:-1, None], pixel)
        return np.clip(overlap, 0, None) * target / source
    centre = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
    return np.clip(1 - np.abs(centre[:, None] - np.arange(source)), 0, None)


def resize_pixels(planar: np.ndarray, height: int, width: int) -> np.ndarray:
    down, across = resampling(planar.shape[1], height), resampling(planar.shape[2], width)
    return np.floor(down @ planar.astype("f8") @ across.T + 0.5).astype("u1")


def to_planar_rgb(image: Column, height: int | None = None, width: int | None = None) -> Column:
    """Spark's `image` struct (rows of blue-green-red pixels) to planar red, green and blue bytes.

    With both `height` and `width` the image is forced to that size whatever its aspect ratio.
    """
    def planes(images: pa.Array) -> pa.Array:
        fields = [images.field(name) for name in ("data", "height", "width", "nChannels")]
        rows = zip(images.is_valid().to_pylist(), *fields)
        out = []
        for valid, data, h, w, c in rows:
            if not valid or not data.is_valid:
                out.append(None)
                continue
            pixels = _planar(data.as_buffer(), h.as_py(), w.as_py(), c.as_py())
            if height and width:
                pixels = resize_pixels(pixels, height, width)
            out.append(pixels.tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(planes, T.BinaryType())(image)
