"""Spatial filters and spike removal on tiles with a halo."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import finite
from heightfield.model import ImageSet
from heightfield.plans.layout import TILE, attach, halo_tiles, tile_pixels, with_geometry

FILTER_KINDS = ("Mean", "Median", "Gaussian", "Sharpen", "Sobel", "Laplacian")
SIZED = ("Mean", "Median", "Gaussian")

# 3x3 kernels, row-major.
SHARPEN = ((0, -1, 0), (-1, 5, -1), (0, -1, 0))
LAPLACIAN = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def gaussian_kernel(size: int) -> np.ndarray:
    """Unit-gain square Gaussian with sigma = max(size / 6, 0.5)."""
    sigma = max(size / 6.0, 0.5)
    d = np.arange(size) - size // 2
    k = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def _window(p, z, wh, ww) -> np.ndarray:
    grid = np.full(wh * ww, np.nan, dtype=np.float32)
    grid[p] = z
    return grid.reshape(wh, ww)


def _neighbours(p, z, row, r: int) -> np.ndarray:
    """Edge-replicated neighbourhoods of a tile core, shape (ch, cw, 2r+1, 2r+1)."""
    win = _window(p, z, row.wh, row.ww)
    ys = np.clip(np.arange(row.y0 - r, row.y0 + row.ch + r), 0, row.h - 1) - row.wy
    xs = np.clip(np.arange(row.x0 - r, row.x0 + row.cw + r), 0, row.w - 1) - row.wx
    padded = win[np.ix_(ys, xs)]
    return np.lib.stride_tricks.sliding_window_view(padded, (2 * r + 1, 2 * r + 1))


def _weighted(views: np.ndarray, kernel) -> np.ndarray:
    out = np.zeros(views.shape[:2])
    for dy, line in enumerate(kernel):
        for dx, weight in enumerate(line):
            out += weight * views[:, :, dy, dx].astype(np.float64)
    return out


def _median(views: np.ndarray) -> np.ndarray:
    flat = views.reshape(*views.shape[:2], -1)
    # NaN sorts first here: it goes to the low end as -inf and is restored when it is the middle
    gaps = np.isnan(flat)
    mid = flat.shape[-1] // 2
    ordered = np.partition(np.where(gaps, -np.inf, flat), mid, axis=-1)[..., mid]
    return np.where(gaps.sum(axis=-1) > mid, np.nan, ordered)


def _finite_median(views: np.ndarray) -> np.ndarray:
    flat = views.reshape(*views.shape[:2], -1).astype(np.float64)
    ok = np.isfinite(flat)
    n = ok.sum(axis=-1)
    ordered = np.sort(np.where(ok, flat, np.inf), axis=-1)
    lo = np.take_along_axis(ordered, np.maximum((n - 1) // 2, 0)[..., None], axis=-1)[..., 0]
    hi = np.take_along_axis(ordered, np.minimum(n // 2, flat.shape[-1] - 1)[..., None], axis=-1)[..., 0]
    with np.errstate(invalid="ignore"):
        return np.where(n > 0, (lo + hi) / 2.0, np.nan)


def _apply(kind: str, size: int, views: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        if kind == "Mean":
            return _weighted(views, np.full((size, size), 1.0 / (size * size)))
        if kind == "Gaussian":
            return _weighted(views, gaussian_kernel(size))
        if kind == "Median":
            return _median(views)
        if kind == "Sobel":
            gx, gy = _weighted(views, SOBEL_X), _weighted(views, SOBEL_Y)
            return np.sqrt(gx * gx + gy * gy)
        return _weighted(views, SHARPEN if kind == "Sharpen" else LAPLACIAN)


_WINDOW = ("p", "z", "y0", "x0", "ch", "cw", "wy", "wx", "wh", "ww", "h", "w")


def _stencil(images: ImageSet, radius: int, tile: int, fn) -> DataFrame:
    """One tile exchange; ``fn`` sees the neighbourhoods of a tile core and returns the core."""
    @pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            frame = pd.concat(cols, axis=1, keys=_WINDOW)
            yield pd.Series([fn(_neighbours(r.p, r.z, r, radius)).astype(np.float32).ravel()
                             for r in frame.itertuples(index=False)], dtype=object)

    tiles = halo_tiles(with_geometry(images), reach_y=radius, reach_x=radius, tile_h=tile, tile_w=tile)
    return tile_pixels(tiles.withColumn("out", run(*_WINDOW)), "out")


def spatial_filter(images: ImageSet, kind: str = "Mean", size: int = 3, tile: int = TILE) -> ImageSet:
    """Mean, Median, Gaussian (odd size 3-9), Sharpen, Sobel, Laplacian (3x3), edges replicated."""
    if kind not in FILTER_KINDS:
        raise ValueError(f"unknown filter {kind!r}")
    size = size if kind in SIZED else 3
    if size % 2 == 0 or not 3 <= size <= 9:
        raise ValueError("the kernel size must be odd, 3 to 9")
    return images.with_pixels(_stencil(images, size // 2, tile, lambda views: _apply(kind, size, views)))


def deglitch(images: ImageSet, threshold: float = 3.0, tile: int = TILE) -> ImageSet:
    """Replace spikes and non-finite pixels by the median of the finite 3x3 neighbourhood."""
    z = F.col("z")
    noise = images.geometry().join(
        images.pixels.filter(finite(z)).groupBy("dataset_id").agg(F.stddev_pop(z.cast("double")).alias("sd")),
        "dataset_id", "left")
    rows = attach(images, images.pixels, noise)

    @pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            frame = pd.concat(cols, axis=1, keys=(*_WINDOW, "sd"))
            yield pd.Series([_despike(r, threshold) for r in frame.itertuples(index=False)], dtype=object)

    tiles = halo_tiles(rows, reach_y=1, reach_x=1, tile_h=tile, tile_w=tile, carry=("sd",))
    return images.with_pixels(tile_pixels(tiles.withColumn("out", run(*_WINDOW, "sd")), "out"))


def _despike(row, threshold: float) -> np.ndarray:
    views = _neighbours(row.p, row.z, row, 1)
    centre = views[:, :, 1, 1]
    middle = _finite_median(views)
    with np.errstate(invalid="ignore"):
        far = (row.sd > 0) & (np.abs(centre.astype(np.float64) - middle) > threshold * row.sd)
    spike = np.isfinite(middle) & (~np.isfinite(centre) | far)
    return np.where(spike, middle.astype(np.float32), centre).ravel()
