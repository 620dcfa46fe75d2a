"""Pixel-wise operators: arithmetic, crop, flips, cross-sections, quick-looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heightfield.functions import colormaps
from heightfield.functions.expr import clamp, finite, nan, raw_to_real
from heightfield.model import CurveSet, ImageSet
from heightfield.operators.statistics import finite_range
from heightfield.plans.layout import attach, with_geometry

PIXEL_KINDS = ("Invert", "AbsoluteValue", "Offset", "Scale")
GEOMETRY_KINDS = ("FlipHorizontal", "FlipVertical", "Rotate180", "Rotate90Cw", "Rotate90Ccw")


def pixel_math(images: ImageSet, kind: str = "Invert", amount: float = 0.0) -> ImageSet:
    """Invert about the finite mid, absolute value, offset or scale; non-finite pixels pass through."""
    z = F.col("z")
    rows = images.pixels
    if kind == "Invert":
        mirror = images.scans.select("dataset_id").join(finite_range(rows), "dataset_id", "left")
        rows = attach(images, rows, mirror)
        new = F.coalesce(F.col("lo") + F.col("hi"), F.lit(0.0)) - z.cast("double")
    elif kind == "AbsoluteValue":
        new = F.abs(z)
    elif kind == "Offset":
        new = z.cast("double") + float(amount)
    elif kind == "Scale":
        new = z.cast("double") * float(amount)
    else:
        raise ValueError(f"unknown pixel operation {kind!r}")
    out = F.when(finite(z), new.cast("float")).otherwise(z)
    return images.with_pixels(rows.select("dataset_id", "y", "x", out.alias("z")))


def _cropped(ax: Column, start: int, length: Column) -> Column:
    shift = F.when(ax["direction"] == "Reverse", ax["count"] - start - length).otherwise(F.lit(start))
    return ax.withField("origin", ax["origin"] + ax["step"] * shift).withField("count", length.cast("int"))


def crop(images: ImageSet, left: int = 0, top: int = 0, width: int = 128, height: int = 128) -> ImageSet:
    """Window of every image that contains the origin; the extent is clamped, coordinates are kept."""
    x, y = F.col("x"), F.col("y")
    scans = images.scans.filter((x["count"] > left) & (y["count"] > top)).withColumns({
        "x": _cropped(x, left, F.least(F.lit(width), x["count"] - left)),
        "y": _cropped(y, top, F.least(F.lit(height), y["count"] - top)),
    })
    pixels = images.pixels.filter(
        (y >= top) & (y < top + height) & (x >= left) & (x < left + width)
    ).select("dataset_id", (y - top).alias("y"), (x - left).alias("x"), "z")
    # An image whose origin lies outside has no pixel in the window, so the filter alone drops it.
    return images.with_pixels(pixels, scans)


def crop_curve(curves: CurveSet, start: int = 0, count: int = 128) -> CurveSet:
    i, x = F.col("i"), F.col("x")
    scans = curves.scans.filter(x["count"] > start).withColumn(
        "x", _cropped(x, start, F.least(F.lit(count), x["count"] - start)))
    samples = curves.samples.filter((i >= start) & (i < start + count)).select("dataset_id", (i - start).alias("i"), "z")
    return curves.with_samples(samples, scans)


def _reversed(ax: Column) -> Column:
    flipped = F.when(ax["direction"] == "Forward", F.lit("Reverse")).otherwise(F.lit("Forward"))
    return ax.withField("direction", flipped)


def transform(images: ImageSet, kind: str = "Rotate90Cw") -> ImageSet:
    """Flip or rotate by remapping indices; axis directions follow so that coordinates travel with pixels."""
    if kind not in GEOMETRY_KINDS:
        raise ValueError(f"unknown geometry {kind!r}")
    x, y = F.col("x"), F.col("y")
    mx, my = F.col("w") - 1 - x, F.col("h") - 1 - y
    to_x, to_y = {
        "FlipHorizontal": (mx, y), "FlipVertical": (x, my), "Rotate180": (mx, my),
        "Rotate90Cw": (my, x), "Rotate90Ccw": (y, mx),
    }[kind]
    pixels = with_geometry(images).select("dataset_id", to_y.alias("y"), to_x.alias("x"), "z")
    ax = {
        "FlipHorizontal": (_reversed(x), y), "FlipVertical": (x, _reversed(y)),
        "Rotate180": (_reversed(x), _reversed(y)),
        "Rotate90Cw": (_reversed(y), x), "Rotate90Ccw": (y, _reversed(x)),
    }[kind]
    return images.with_pixels(pixels, images.scans.withColumns({"x": ax[0], "y": ax[1]}))


def cross_section(images: ImageSet, orientation: str = "Row", index: int = 0) -> CurveSet:
    """Exact copy of one row or column of every image that has it; keeps the source axis."""
    row = orientation == "Row"
    if not row and orientation != "Column":
        raise ValueError(f"unknown orientation {orientation!r}")
    keep, across = ("x", "y") if row else ("y", "x")
    samples = images.pixels.filter(F.col(across) == index).select("dataset_id", F.col(keep).alias("i"), "z")
    scans = images.scans.filter(F.col(across)["count"] > index)
    x_axis = F.col(keep)
    scans = scans.withColumns({"kind": F.lit("LineProfile"), "x": x_axis}).drop("y")
    return CurveSet(scans, samples=samples, known_rows=images.rows_if_known)


def curve_points(curves: CurveSet) -> DataFrame:
    """Curves as (dataset_id, i, x, z) with physical abscissae."""
    table = curves.scans.select("dataset_id", F.col("x").alias("ax"))
    return attach(curves, curves.samples, table).select(
        "dataset_id", "i", raw_to_real(F.col("ax"), F.col("i")).alias("x"), "z")


def curve_y_range(curves: CurveSet) -> DataFrame:
    """Finite value range per curve; 0..0 where nothing is finite."""
    return curves.scans.select("dataset_id").join(finite_range(curves.samples), "dataset_id", "left").select(
        "dataset_id", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))


def normalise(images: ImageSet, low: float | None = None, high: float | None = None) -> DataFrame:
    """(dataset_id, y, x, z, level): clamped position in the range; NaN for non-finite, 0 for an empty range.

    Without explicit bounds the range is each image's finite data range ([0, 1] if it has none).
    """
    if low is None or high is None:
        spans = images.scans.select("dataset_id").join(finite_range(images.pixels), "dataset_id", "left").select(
            "dataset_id", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
        rows = attach(images, images.pixels, spans)
    else:
        rows = images.pixels.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    span = F.col("hi") - F.col("lo")
    level = (F.when(~finite(F.col("z")), nan()).when(span <= 0, F.lit(0.0))
             .otherwise(clamp((F.col("z").cast("double") - F.col("lo")) / F.when(span > 0, span).otherwise(F.lit(1.0)), 0.0, 1.0)))
    return rows.select("dataset_id", "y", "x", "z", level.alias("level"))


def quicklook(images: ImageSet, colormap: str = "Gold") -> DataFrame:
    """(dataset_id, y, x, r, g, b)."""
    return normalise(images).select("dataset_id", "y", "x", *colormaps.colour(F.col("level"), colormap))


def preview(images: ImageSet, nodes: int = 256) -> DataFrame:
    """Endpoint-inclusive decimation to at most ``nodes`` per axis: (dataset_id, gy, gx, y, x, z).

    Node g sits at round(g * (count - 1) / (grid - 1)); each pixel tests the one node it can
    belong to, so nothing is joined or generated.
    """
    rows = with_geometry(images)

    def node(index: Column, count: Column) -> tuple[Column, Column]:
        grid = F.least(count, F.lit(nodes))
        steps = F.greatest(grid - 1, F.lit(1))
        last = F.greatest(count - 1, F.lit(1))
        near = F.floor(index * steps / last + 0.5).cast("int")
        # integer form of round-half-up of g * last / steps
        at = F.floor((2.0 * near * (count - 1) + steps) / (2 * steps)).cast("int")
        return near, at

    gy, ny = node(F.col("y"), F.col("h"))
    gx, nx = node(F.col("x"), F.col("w"))
    return rows.filter((ny == F.col("y")) & (nx == F.col("x"))).select(
        "dataset_id", gy.alias("gy"), gx.alias("gx"), "y", "x", "z")


def calibrate(rows: DataFrame, raw: str, gain: float | Column, offset: float | Column, out: str = "z") -> DataFrame:
    """Raw counts to physical floats."""
    g = gain if isinstance(gain, Column) else F.lit(float(gain))
    o = offset if isinstance(offset, Column) else F.lit(float(offset))
    return rows.withColumn(out, (F.col(raw) * g + o).cast("float"))
