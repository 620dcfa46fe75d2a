"""Grain detection: 8-connected components above a relative height."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import finite, floordiv, ratio
from heightfield.model import ImageSet
from heightfield.operators.statistics import finite_range
from heightfield.plans.iterate import cut
from heightfield.plans.layout import TILE, attach, halo_tiles

# Tiles along one edge of a super-tile.
FAN = 16


def label_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-connected labelling by horizontal runs: (y, first x, length, representative run) per run.

    Runs come in row-major order and each component is named by its first run.
    """
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    stride = mask.shape[1] + 2
    # runs of the next row that touch or overlap [start, stop], corners included
    low = np.searchsorted(y * stride + stop, (y + 1) * stride + start, side="left")
    high = np.searchsorted(y * stride + start, (y + 1) * stride + stop, side="right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(y.size), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    parent = np.arange(y.size)
    while True:
        pa, pb = parent[a], parent[b]
        if np.array_equal(pa, pb):
            return y, start, stop - start, parent
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]


def _tile_grains(p, z, wh, ww, y0, x0, w, threshold, edges: bool):
    grid = np.full(wh * ww, np.nan)
    grid[p] = z
    grid = grid.reshape(wh, ww)
    with np.errstate(invalid="ignore"):
        mask = np.isfinite(grid) & (grid >= threshold)
    y, x, length, parent = label_runs(mask)
    if not y.size:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0), none, none, none
    name = (y0 + y[parent]).astype(np.int64) * w + (x0 + x[parent])
    area = np.bincount(parent, weights=length, minlength=y.size)
    height = np.bincount(np.repeat(parent, length), weights=grid[mask], minlength=y.size)
    heads = np.flatnonzero(parent == np.arange(y.size))
    rim_y = rim_x = rim_name = np.empty(0, dtype=np.int64)
    if edges:
        py, px = np.nonzero(mask)
        on = (py == 0) | (px == 0) | (py == wh - 1) | (px == ww - 1)
        rim_y, rim_x, rim_name = py[on] + y0, px[on] + x0, np.repeat(name, length)[on]
    return name[heads], area[heads].astype(np.int64), height[heads], rim_y, rim_x, rim_name


def _merge(y, x, grain, extent: int):
    """Join the grains of neighbouring tiles inside one super-tile of ``extent`` pixels, from the rims of the tiles.

    Returns the grains that get another name with that name (the smallest of the joined ones), and the rim of the super-tile.
    """
    y, x, grain = (np.concatenate([np.asarray(v, dtype=np.int64) for v in vs]) if len(vs) else np.empty(0, np.int64) for vs in (y, x, grain))
    if not y.size:
        return grain, grain, y, x, grain
    stride = int(x.max()) + 3
    key = y * stride + x
    order = np.argsort(key)
    key, y, x, grain = key[order], y[order], x[order], grain[order]
    names, g = np.unique(grain, return_inverse=True)
    parent = np.arange(names.size)
    ends = []
    for step in (1, stride - 1, stride, stride + 1):  # right, and the three below
        at = np.minimum(np.searchsorted(key, key + step), key.size - 1)
        hit = (key[at] == key + step) & (g[at] != g)
        ends.append(np.stack([g[hit], g[at[hit]]]))
    a, b = np.unique(np.concatenate(ends, axis=1), axis=1)
    while True:
        pa, pb = parent[a], parent[b]
        if np.array_equal(pa, pb):
            break
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    moved = parent != np.arange(names.size)
    on = (y % extent == 0) | (x % extent == 0) | (y % extent == extent - 1) | (x % extent == extent - 1)
    return names[moved], names[parent[moved]], y[on], x[on], names[parent[g[on]]]


def grain_table(images: ImageSet, threshold: float = 0.5, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """One row per grain: (dataset_id, grain, area, height_sum).

    Tiles are labelled apart.  Then ``fan`` x ``fan`` tiles at a time are joined along their rims in one task, and only the rim of the
    super-tile goes on to the next level, until every image is one super-tile; the catalog tells how many levels that takes (none
    where every image fits a tile).  A grain is summed up per super-tile before it meets its next name, so names are unique on both
    sides of that join however large the grain is.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("the threshold must be 0 to 1")
    several = images.widest > tile
    level = F.col("lo") + threshold * (F.col("hi") - F.col("lo"))
    cuts = images.geometry().join(finite_range(images.pixels).select("dataset_id", level.alias("level")), "dataset_id")
    tiles = halo_tiles(attach(images, images.pixels, cuts), tile_h=tile, tile_w=tile, carry=("level",))

    fields = ("grain", "area", "height", "ry", "rx", "rg")

    @pandas_udf("struct<grain:array<bigint>,area:array<bigint>,height:array<double>,"
                "ry:array<bigint>,rx:array<bigint>,rg:array<bigint>>")
    def label(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            done = [_tile_grains(*v, several) for v in zip(*cols)]
            yield pd.DataFrame({f: pd.Series([d[k] for d in done], dtype=object) for k, f in enumerate(fields)})

    labelled = tiles.select("dataset_id", "ty", "tx", label("p", "z", "wh", "ww", "y0", "x0", "w", "level").alias("t")).select("dataset_id", "ty", "tx", "t.*")
    if several:
        labelled = cut(labelled)  # read by the grains and by the rims; far smaller than the pixels
    parts = labelled.select("dataset_id", F.explode(F.arrays_zip("grain", "area", "height")).alias("g")).select(
        "dataset_id", F.col("g.grain").alias("grain"), F.col("g.area").alias("area"), F.col("g.height").alias("height_sum"))
    extent = tile
    while extent < images.widest:
        extent *= fan
        merged = cut(_super_tiles(labelled, fan, extent))
        names = merged.select("dataset_id", F.explode(F.arrays_zip("grain", "root")).alias("m")).select(
            "dataset_id", F.col("m.grain").alias("grain"), F.col("m.root").alias("root"))
        parts = (parts.join(names, ["dataset_id", "grain"], "left").groupBy("dataset_id", F.coalesce("root", "grain").alias("grain"))
                 .agg(F.sum("area").alias("area"), F.sum("height_sum").alias("height_sum")))
        labelled = merged
    return parts


def _super_tiles(tiles: DataFrame, fan: int, extent: int) -> DataFrame:
    """(dataset_id, ty, tx, grain, root, ry, rx, rg): the tiles of the next level, their joined grains and their rims."""
    fields = ("grain", "root", "ry", "rx", "rg")

    @pandas_udf("struct<grain:array<bigint>,root:array<bigint>,ry:array<bigint>,rx:array<bigint>,rg:array<bigint>>")
    def merge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            done = [_merge(*v, extent) for v in zip(*cols)]
            yield pd.DataFrame({f: pd.Series([d[k] for d in done], dtype=object) for k, f in enumerate(fields)})

    groups = tiles.groupBy("dataset_id", floordiv(F.col("ty"), fan).alias("ty"), floordiv(F.col("tx"), fan).alias("tx")).agg(
        *[F.collect_list(v).alias(v) for v in ("ry", "rx", "rg")])
    return groups.select("dataset_id", "ty", "tx", merge("ry", "rx", "rg").alias("t")).select("dataset_id", "ty", "tx", "t.*")


def grains(images: ImageSet, threshold: float = 0.5, min_area: int = 3, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """GrainCount, Coverage (of the finite pixels), MeanArea (pixels) and MeanHeight per image."""
    if min_area < 1:
        raise ValueError("the minimum area must be positive")
    kept = grain_table(images, threshold, tile, fan).filter(F.col("area") >= min_area).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.sum("height_sum").alias("height"))
    valid = images.pixels.groupBy("dataset_id").agg(F.count(F.when(finite(F.col("z")), 1)).alias("valid"))
    c = F.col
    area, n = F.coalesce("area", F.lit(0)), F.coalesce("n", F.lit(0))
    return (images.scans.select("dataset_id").join(valid, "dataset_id", "left").join(kept, "dataset_id", "left").select(
        "dataset_id", n.cast("long").alias("GrainCount"), ratio(area, F.coalesce("valid", F.lit(0)), 0.0).alias("Coverage"),
        ratio(area, n, 0.0).alias("MeanArea"), ratio(F.coalesce(c("height"), F.lit(0.0)), area, 0.0).alias("MeanHeight")))
