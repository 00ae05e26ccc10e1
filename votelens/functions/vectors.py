"""Image vectors as arrays of doubles (square images, column by column)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .scalars import hash_unit

LARGEST = float(np.finfo(np.float64).max)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside array lambdas it would be recomputed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _num(v: Column) -> Column:
    return (F.when(F.isnan(v), 0.0).when(v == float("inf"), LARGEST).when(v == float("-inf"), -LARGEST).otherwise(v))


def nan_to_num(x: Column) -> Column:
    return F.transform(x, _num)


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def vec_mean(x: Column) -> Column:
    return F.try_divide(_sum(x), F.size(x))


def vec_std(x: Column) -> Column:
    """Population standard deviation."""
    return let(vec_mean(x), lambda m: F.sqrt(F.try_divide(_sum(x, lambda v: (v - m) * (v - m)), F.size(x))))


def _max_abs(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def sign_log_norm(x: Column) -> Column:
    """sign(v) * log1p(|v| / sd); 0 where the value or the deviation is 0."""
    clean = nan_to_num(x)
    return let(clean, lambda c: let(vec_std(c), lambda s: F.transform(
        c, lambda v: F.when((v == 0) | (s == 0), F.when((s == 0) & (v != 0), F.signum(v) * LARGEST).otherwise(0.0))
        .otherwise(F.signum(v) * F.log1p(F.abs(v) / s)))))


def _ratio(a: Column, b: Column) -> Column:
    """a / b with the floating-point results for a zero divisor."""
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, zero).otherwise(a / b)


def rescale_abs(x: Column) -> Column:
    return let(_max_abs(x), lambda m: F.transform(x, lambda v: _ratio(v, m)))


def mean_subtract(x: Column) -> Column:
    return let(vec_mean(x), lambda m: F.transform(x, lambda v: v - m))


def feature_standardise(x: Column) -> Column:
    """Mean subtracted, divided by the largest magnitude, then by the deviation."""
    return let(rescale_abs(mean_subtract(x)), lambda c: let(vec_std(c), lambda s: F.transform(c, lambda v: _ratio(v, s))))


def _pick(x: Column, index: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, index)), lambda j: F.get(x, j))


def centre_crop(x: Column, side: int, extent: int) -> Column:
    """The 2 extent x 2 extent square around the centre of a ``side`` x ``side`` image."""
    lo = side // 2 - extent
    n = 2 * extent
    return _pick(x, [(c + lo) * side + (r + lo) for c in range(n) for r in range(n)])


def rotations(side: int) -> list[list[int]]:
    """Source index of each pixel after 0..3 quarter turns to the left."""
    at = np.arange(side * side).reshape((side, side), order="F")
    return [np.rot90(at, k).ravel(order="F").tolist() for k in range(4)]


def rotate_augment(df: DataFrame, vector: str, side: int, turns: int = 3) -> DataFrame:
    """Each row and its quarter turns, other columns repeated."""
    turned = F.array(*[_pick(F.col(vector), r) for r in rotations(side)[:turns + 1]])
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, F.posexplode(turned).alias("turn", vector))


def random_patches(df: DataFrame, id_: str, vector: str, side: int, patch: int, n: int, seed=0) -> DataFrame:
    """n patches per image at hash-drawn corners; the last possible corner is never drawn."""
    corners = side - patch
    draw = lambda axis: F.floor(hash_unit(F.concat_ws("/", F.col(id_), F.col("patch")), f"{seed}{axis}") * corners).cast("int")
    rows = df.withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumns({"top": draw("r"), "left": draw("c")})
    strips = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(patch - 1)),
                                   lambda c: F.slice(F.col(vector), (F.col("left") + c) * side + F.col("top") + 1, patch)))
    return rows.select(*[c for c in df.columns if c != vector], "patch", "top", "left", strips.alias(vector))


def scale_pm1(x: Column) -> Column:
    """0..255 to -1..1."""
    return F.transform(x, lambda v: (v / 255 - .5) * 2)


# ---- batch functions (two-dimensional work on Arrow batches) ---------------------------------

def _images(batch: pd.DataFrame, vector: str, side: int) -> np.ndarray:
    """(rows, side, side) with [row, column] indexing."""
    flat = np.stack(batch[vector].to_numpy()).astype(float)
    return flat.reshape(len(flat), side, side).transpose(0, 2, 1)


def _flat(images: np.ndarray) -> list:
    return list(images.transpose(0, 2, 1).reshape(len(images), -1))


def convolve(df: DataFrame, id_: str, vector: str, side: int, filters: np.ndarray, patch: int,
             pool: int | None = None) -> DataFrame:
    """Valid two-dimensional filter responses sqrt(r^2 + 1e-8); with ``pool`` summed over pool x pool cells.

    One output row per (image, filter). ``filters`` (k, patch^2) is a model, not data: its size does not
    follow the table's.
    """
    bank = np.asarray(filters, dtype=float).reshape(-1, patch, patch).transpose(0, 2, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            win = np.lib.stride_tricks.sliding_window_view(_images(b, vector, side), (patch, patch), axis=(1, 2))
            for k, f in enumerate(bank):
                out = np.sqrt(np.einsum("nijab,ab->nij", win, f) ** 2 + 1e-8)
                if pool:
                    d = out.shape[1] // pool
                    out = out[:, :d * pool, :d * pool].reshape(len(b), d, pool, d, pool).sum(axis=(2, 4))
                yield pd.DataFrame({id_: b[id_], "filter": np.int32(k), "response": _flat(out)})

    key = df.schema[id_].dataType.simpleString()
    return df.select(id_, vector).mapInPandas(run, f"{id_} {key}, filter int, response array<double>")


def gaussian_blur(images: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = int(4 * sigma + .5)
    k = np.exp(-.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        win = np.lib.stride_tricks.sliding_window_view(np.pad(images, pad, mode="symmetric"), len(k), axis=axis)
        images = win @ k
    return images


def reconstruct_by_dilation(seed: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grow the seed over 3 x 3 neighbourhoods under the mask until nothing changes."""
    while True:
        win = np.lib.stride_tricks.sliding_window_view(
            np.pad(seed, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf), (3, 3), axis=(1, 2))
        grown = np.minimum(win.max(axis=(3, 4)), mask)
        if np.array_equal(grown, seed):
            return seed
        seed = grown


def background_subtract(df: DataFrame, id_: str, vector: str, side: int) -> DataFrame:
    """Sign-log normalised image, blurred, minus its reconstruction from the border."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            image = gaussian_blur(_images(b, vector, side))
            seed = image.copy()
            seed[:, 1:-1, 1:-1] = image.min(axis=(1, 2), keepdims=True)
            yield pd.DataFrame({id_: b[id_], vector: _flat(image - reconstruct_by_dilation(seed, image))})

    key = df.schema[id_].dataType.simpleString()
    normed = df.select(id_, sign_log_norm(F.col(vector)).alias(vector))
    return normed.mapInPandas(run, f"{id_} {key}, {vector} array<double>")
