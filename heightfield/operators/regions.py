"""Many regions on many images: masks, counts and per-region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.functions.expr import clamp, finite, floordiv
from heightfield.functions.regions import Region, contains, in_ellipse, region_literal
from heightfield.model import ImageSet
from heightfield.operators.statistics import areal, fill_missing, moments
from heightfield.plans.layout import TILE, attach


def region_table(images: ImageSet, regions: list[Region]) -> DataFrame:
    """The regions on every image: (dataset_id, region, w, h), one row per image and region."""
    literal = F.array(*[region_literal(r) for r in regions])
    return images.geometry().select("dataset_id", "w", "h", F.explode(literal).alias("region"))


def masked_pixels(images: ImageSet, regions: DataFrame) -> DataFrame:
    """Pixels inside each region: (dataset_id, region_id, y, x, z).

    ``regions`` is (dataset_id, region, w, h), such as :func:`region_table`.  A region is
    expanded to the image tiles its box touches, so the join is an equi-join on
    (dataset_id, tile): a pixel meets only the regions near it, and a giant image is spread
    over its tiles.  The exact shape test follows as a filter.
    """
    fields = ("region_id", "kind", "left", "top", "width", "height", "vertices")
    r = {f: F.col(f"_{f}") for f in fields}

    def span(start, size, count):
        lo = clamp(start, 0.0, F.col(count).cast("double"))
        hi = clamp(start + size, 0.0, F.col(count).cast("double"))
        first, last = floordiv(F.floor(lo), TILE), floordiv(F.ceil(hi) - 1, TILE)
        return F.when(hi > lo, F.sequence(first, F.greatest(first, last)))

    flat = regions.select("dataset_id", "w", "h", *[F.col("region")[f].alias(f"_{f}") for f in fields])
    spans = flat.withColumns({
        "_ys": span(r["top"], r["height"], "h"), "_xs": span(r["left"], r["width"], "w"),
    }).filter(F.col("_ys").isNotNull() & F.col("_xs").isNotNull()).drop("w", "h")
    covered = spans.withColumn("_by", F.explode("_ys")).withColumn("_bx", F.explode("_xs")).drop("_ys", "_xs")
    rows = images.pixels.withColumns({"_by": floordiv(F.col("y"), TILE), "_bx": floordiv(F.col("x"), TILE)})
    return (rows.join(covered, ["dataset_id", "_by", "_bx"])
            .filter(contains(r, F.col("x") + 0.5, F.col("y") + 0.5))
            .select("dataset_id", r["region_id"].alias("region_id"), "y", "x", "z"))


def mask_counts(images: ImageSet, regions: list[Region]) -> DataFrame:
    """Grid pixels inside each region: (dataset_id, region_id, n), zero included."""
    table = region_table(images, regions)
    counts = masked_pixels(images, table).groupBy("dataset_id", "region_id").agg(F.count(F.lit(1)).alias("n"))
    return fill_missing(counts, table.select("dataset_id", F.col("region.region_id").alias("region_id")), ("n",))


def region_moments(images: ImageSet, rows: DataFrame, regions: int) -> DataFrame:
    keys = ("dataset_id", "region_id")
    return moments(rows, keys, attach_mean=lambda r, first: attach(images, r, first, keys=keys, per_member=regions))


def region_roughness(images: ImageSet, regions: list[Region]) -> DataFrame:
    """Areal roughness of each region of each image; an empty region gives NaN."""
    table = region_table(images, regions)
    stats = region_moments(images, masked_pixels(images, table), len(regions))
    return fill_missing(areal(stats, "dataset_id", "region_id"),
                        table.select("dataset_id", F.col("region.region_id").alias("region_id")))


def _boxed(images: ImageSet, shape: str, left: int, top: int, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Images (dataset_id, w, h) that hold the origin of the box, and their pixels in it."""
    if shape not in ("Rectangle", "Ellipse"):
        raise ValueError(f"unknown shape {shape!r}")
    inside = images.geometry().filter((F.col("w") > left) & (F.col("h") > top))
    x, y = F.col("x"), F.col("y")
    rows = images.pixels.filter((x >= left) & (x < left + width) & (y >= top) & (y < top + height))
    if shape == "Ellipse":
        box = inside.select("dataset_id", F.least(F.lit(width), F.col("w") - left).alias("_ew"),
                            F.least(F.lit(height), F.col("h") - top).alias("_eh"))
        rows = attach(images, rows, box).filter(
            in_ellipse(x + 0.5, y + 0.5, F.lit(float(left)), F.lit(float(top)), F.col("_ew"), F.col("_eh")))
    return inside, rows


def roi_pixels(images: ImageSet, shape: str = "Rectangle", left: int = 0, top: int = 0, width: int = 64, height: int = 64) -> DataFrame:
    """(dataset_id, pixels): pixels of the box or inscribed ellipse, finite or not, zero included."""
    inside, rows = _boxed(images, shape, left, top, width, height)
    return fill_missing(rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("pixels")), inside.select("dataset_id"), ("pixels",))


def roi_statistics(images: ImageSet, shape: str = "Rectangle", left: int = 0, top: int = 0,
                   width: int = 64, height: int = 64) -> DataFrame:
    """Sq, Sa, Sz, Mean, Min, Max, PixelCount of the finite pixels in one box or inscribed ellipse.

    The box is clamped to the image first, so the ellipse is the one inscribed in the clamped
    box.  Images that do not contain the origin are skipped.
    """
    inside, rows = _boxed(images, shape, left, top, width, height)
    rows = rows.filter(finite(F.col("z")))
    stats = moments(rows, attach_mean=lambda r, first: attach(images, r, first))
    named = stats.select("dataset_id", F.col("sq").alias("Sq"), F.col("sa").alias("Sa"), F.col("p2p").alias("Sz"),
                         F.col("mean").alias("Mean"), F.col("lo").alias("Min"), F.col("hi").alias("Max"),
                         F.col("n").alias("PixelCount"))
    return fill_missing(named, inside.select("dataset_id"), ("PixelCount",))
