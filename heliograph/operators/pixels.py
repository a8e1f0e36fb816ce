"""Pixel arithmetic and patch masks; binary images go through NumPy in Arrow batches, arrays through built-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.functions.arrays import indices, let

#: The sky circle's centre and radius by image size.
SKY = {64: (30, 30, 31), 224: (108, 110, 108)}
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def map_images(df: DataFrame, work: Callable[[np.ndarray], np.ndarray], image: str = "image") -> DataFrame:
    """Each image struct (``height, width, nChannels, data``) through ``work`` on an (h, w, c) byte array; others columns stay."""
    at = df.columns.index(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(at).to_pylist():
                if x is not None:
                    pixels = work(np.frombuffer(x["data"], np.uint8).reshape(x["height"], x["width"], x["nChannels"]))
                    x = x | {"height": pixels.shape[0], "width": pixels.shape[1], "data": np.ascontiguousarray(pixels).tobytes()}
                rows.append(x)
            columns = list(batch.columns)
            columns[at] = pa.array(rows, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, df.schema)


def center_crop(df: DataFrame, h: int, w: int) -> DataFrame:
    def cut(x: np.ndarray) -> np.ndarray:
        top, left = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
        return x[top : top + h, left : left + w]

    return map_images(df, cut)


def sample_points(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``m`` half-pixel places along ``n`` pixels: the pixels on both sides and the weight of the second."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, n - 1), at - low


def bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Half-pixel bilinear resampling, rounded."""
    y0, y1, fy = sample_points(x.shape[0], h)
    x0, x1, fx = sample_points(x.shape[1], w)
    rows = x[y0] * (1 - fy)[:, None, None] + x[y1] * fy[:, None, None]
    return np.rint(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]).astype(np.uint8)


def resize(df: DataFrame, size: int) -> DataFrame:
    return map_images(df, lambda x: bilinear(x, size, size))


def square_corner(h: int, w: int, size: int, index: int) -> tuple[int, int]:
    """Top and left of the first, middle or last square along the longer side."""
    top, left = -(-(h - size) // 2), -(-(w - size) // 2)
    return ((0, top, h - size)[index], left) if h > w else (top, (0, left, w - size)[index])


def uniform_crop(df: DataFrame, size: int, index: int) -> DataFrame:
    """Left, centre or right square (top, centre, bottom of a taller image)."""

    def cut(x: np.ndarray) -> np.ndarray:
        top, left = square_corner(*x.shape[:2], size, index)
        return x[top : top + size, left : left + size]

    return map_images(df, cut)


def gather(pixels: Column, at: Callable[[Column], Column], n: int) -> Column:
    """The ``n`` values of a flattened image at the computed places ``at(0), at(1), …``."""
    return let(pixels, lambda x: F.transform(indices(n), lambda k: F.get(x, at(k))))


def _window(pixels: Column, width: int, channels: int, top: int, left: int, h: int, w: int) -> Column:
    row, column, channel = (lambda k: F.floor(k / (w * channels))), (lambda k: F.floor(k / channels) % w), (lambda k: k % channels)
    return gather(pixels, lambda k: (((row(k) + top) * width + column(k) + left) * channels + channel(k)).cast("int"), h * w * channels)


def center_crop_array(pixels: Column, shape: tuple[int, int, int], h: int, w: int) -> Column:
    """The middle ``h`` x ``w`` of an image that is flattened by row, column and channel; ``shape`` is that of the image."""
    return _window(pixels, shape[1], shape[2], (shape[0] - h) // 2, (shape[1] - w) // 2, h, w)


def uniform_crop_array(pixels: Column, shape: tuple[int, int, int], size: int, index: int) -> Column:
    """Left, centre or right square (top, centre, bottom of a taller image) of a flattened image, like ``uniform_crop``."""
    top, left = square_corner(shape[0], shape[1], size, index)
    return _window(pixels, shape[1], shape[2], top, left, size, size)


def resize_array(pixels: Column, shape: tuple[int, int, int], h: int, w: int) -> Column:
    """Half-pixel bilinear resampling of a flattened image, not rounded; places and weights of rows and columns are constants."""
    height, width, channels = shape
    literal = lambda x: F.array(*[F.lit(v) for v in x.tolist()])
    (y0, y1, fy), (x0, x1, fx) = (tuple(literal(v) for v in sample_points(*ends)) for ends in ((height, h), (width, w)))

    def value(x: Column, k: Column) -> Column:
        i, j, c = F.floor(k / (w * channels)).cast("int"), (F.floor(k / channels) % w).cast("int"), k % channels
        at = lambda rows, columns: F.get(x, (F.get(rows, i) * width + F.get(columns, j)) * channels + c)
        down, right = F.get(fy, i), F.get(fx, j)
        left_ = at(y0, x0) * (1 - down) + at(y1, x0) * down
        right_ = at(y0, x1) * (1 - down) + at(y1, x1) * down
        return left_ * (1 - right) + right_ * right

    return let(pixels, lambda x: F.transform(indices(h * w * channels), lambda k: value(x, k)))


def normalize_channels(pixels: Column, mean: tuple[float, ...] = MEAN, std: tuple[float, ...] = STD) -> Column:
    """Bytes of a flattened image to (x / 255 - mean) / std, each channel by its own; channels come last."""
    m, s = (F.array(*[F.lit(v) for v in values]) for values in (mean, std))
    return F.transform(pixels, lambda v, k: (v / 255 - F.get(m, k % len(mean))) / F.get(s, k % len(std)))


def mask_images(df: DataFrame, size: int) -> DataFrame:
    ci, cj, r = SKY[size]
    i, j = np.ogrid[:size, :size]
    sky = ((i - ci) ** 2 + (j - cj) ** 2 < r * r).astype(np.uint8)[:, :, None]
    return map_images(df, lambda x: x * sky)


def mask_sky(pixels: Column, side: int, ci: int, cj: int, r: int) -> Column:
    """An array of side x side values, zero outside the circle."""
    return F.transform(pixels, lambda v, k: F.when((F.floor(k / side) - ci) * (F.floor(k / side) - ci) + (k % side - cj) * (k % side - cj) < r * r, v).otherwise(F.lit(0.0)))


def normalize(pixels: Column, mean: float, std: float) -> Column:
    return F.transform(pixels, lambda v: (v / 255 - mean) / std)


def clip_shift(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v)) + 0.5)


def delta(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def tube_mask(key: Column, frames: int, patches: int, ratio: float, seed: int) -> Column:
    """``int(ratio * patches)`` patches by lowest md5 of seed, key and patch, the same in every frame."""
    n = int(ratio * patches)
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), p.cast("string"))).alias("h"), p.alias("p"))))
    chosen = F.transform(F.slice(ranked, 1, n), lambda s: s["p"])
    one = F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda p: F.array_contains(chosen, p).cast("int"))
    return F.flatten(F.array_repeat(one, frames))


def random_mask(key: Column, frames: int, patches: int, ratio: float, seed: int) -> Column:
    """``int(ratio * frames * patches)`` of all places of the clip by lowest md5 of seed, key and place."""
    every = frames * patches
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(every - 1)), lambda p: F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"), p.cast("string"))).alias("h"), p.alias("p"))))
    chosen = F.transform(F.slice(ranked, 1, int(ratio * every)), lambda s: s["p"])
    return F.transform(F.sequence(F.lit(0), F.lit(every - 1)), lambda p: F.array_contains(chosen, p).cast("int"))


def running_cell_mask(phase: Column, frames: int, height: int, width: int, ratio: float) -> Column:
    """2 x 2 cells whose ones move one step a frame; flattened by frame, row, column."""
    ones = int(4 * ratio)
    ks = F.sequence(F.lit(0), F.lit(frames * height * width - 1))

    def at(k: Column) -> Column:
        f, y, x = F.floor(k / (height * width)), F.floor(k / width) % height, k % width
        return F.when((2 * (y % 2) + x % 2 + phase + f + 1) % 4 < ones, 1).otherwise(0)

    return F.transform(ks, at)


def patch_targets(frames: np.ndarray, p: int) -> np.ndarray:
    """Frames (t, h, w, c) as tubelets 2 x p x p, each patch and channel brought to mean 0 and deviation 1."""
    t, h, w, c = frames.shape
    x = frames.reshape(t // 2, 2, h // p, p, w // p, p, c).transpose(0, 2, 4, 1, 3, 5, 6).reshape(-1, 2 * p * p, c)
    x = (x - x.mean(axis=1, keepdims=True)) / (np.sqrt(x.var(axis=1, ddof=1, keepdims=True)) + 1e-6)
    return x.reshape(len(x), -1)


def with_patch_targets(df: DataFrame, shape: tuple[int, int, int, int], p: int, clip: str = "clip") -> DataFrame:
    """Each clip (an array of t x h x w x c values) as ``targets``, an array for each patch; other columns stay, a null stays null."""
    at = df.columns.index(clip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else patch_targets(np.asarray(x, float).reshape(shape), p).tolist() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.list_(pa.float64())))], [*batch.schema.names, "targets"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("targets", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def masked_mse(df: DataFrame) -> DataFrame:
    """Mean of the patch errors that the encoder doesn't see and the decoder does: ``sample, patch, pred, target, hidden, decoded``."""
    patches = df.where("hidden and decoded").groupBy("sample", "patch").agg(F.avg((F.col("pred") - F.col("target")) * (F.col("pred") - F.col("target"))).alias("e"))
    return patches.groupBy("sample").agg(F.avg("e").alias("loss"), F.count(F.lit(1)).alias("patches"))
