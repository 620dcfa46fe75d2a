"""Free line profiles: bilinear samples along arbitrary lines drawn on images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.functions.expr import clamp, finite, floordiv, nan
from heightfield.functions.units import is_length, scale_of
from heightfield.model import CurveSet, ImageSet, axis, fitting, rejected
from heightfield.plans.layout import TILE

CORNER_ROWS = 200_000  # corner rows broadcast at most; beyond that both sides are exchanged
SAMPLES = (2, 100_000)  # fixed values: samples a line may ask for


def _placed(images: ImageSet, lines: DataFrame) -> DataFrame:
    """Lines beside their image's axes (NULL where there is no such image), with endpoints clamped into it."""
    c = F.col
    g = images.scans.select("dataset_id", c("x").alias("ax"), c("y").alias("ay"), "channel")
    mx, my = (c("ax.count") - 1).cast("double"), (c("ay.count") - 1).cast("double")
    return lines.join(g, "dataset_id", "left").withColumns({
        "x0": clamp(c("x0"), 0.0, mx), "x1": clamp(c("x1"), 0.0, mx),
        "y0": clamp(c("y0"), 0.0, my), "y1": clamp(c("y1"), 0.0, my)})


def _line_rules() -> list:
    c = F.col
    return [(c("ax").isNull(), "image.unknown", "there is no such image"),
            (~c("samples").between(*SAMPLES), "samples.out-of-range", f"a line takes {SAMPLES[0]} to {SAMPLES[1]} samples"),
            (~(is_length(c("ax.unit")) & is_length(c("ay.unit"))), "axis.not-length", "an axis is not a length"),
            ((c("x0") == c("x1")) & (c("y0") == c("y1")), "line.no-length", "the line has no length inside the image")]


def effective_lines(images: ImageSet, lines: DataFrame) -> DataFrame:
    """Lines that can be sampled, with endpoints clamped into their image; the others are in :func:`rejected_lines`.

    ``lines`` is (line_id, dataset_id, x0, y0, x1, y1, samples).
    """
    return fitting(_placed(images, lines), _line_rules())


def rejected_lines(images: ImageSet, lines: DataFrame) -> DataFrame:
    """(line_id, code, message) of every line without a profile."""
    return rejected(_placed(images, lines), _line_rules(), "line_id")


def line_profiles(images: ImageSet, lines: DataFrame) -> CurveSet:
    """One curve per line, keyed by line_id: NaN where a neighbouring pixel is not finite.

    All lines are sampled in one plan: sample points become four corner lookups that meet the
    pixels in an equi-join.  The corner side is broadcast only when the lines ask for few
    enough samples; its size is known from the line table before anything is joined.  Beyond that, only pixels of tiles that
    a line passes through are exchanged.
    """
    c = F.col
    live = effective_lines(images, lines)
    t = c("i") / (c("samples") - 1)
    at = live.select("line_id", "dataset_id", "x0", "y0", "x1", "y1", "samples", c("ax.count").alias("w"), c("ay.count").alias("h"),
                     F.explode(F.sequence(F.lit(0), c("samples") - 1)).alias("i"))
    at = at.select("line_id", "dataset_id", "i", "w", "h",
                   clamp(c("x0") + t * (c("x1") - c("x0")), 0.0, c("w") - 1.0).alias("px"),
                   clamp(c("y0") + t * (c("y1") - c("y0")), 0.0, c("h") - 1.0).alias("py"))
    at = at.withColumns({
        "ix": F.greatest(F.lit(0), F.least(F.floor("px").cast("int"), c("w") - 2)),
        "iy": F.greatest(F.lit(0), F.least(F.floor("py").cast("int"), c("h") - 2))})
    corner = F.explode(F.array(*[F.struct(F.lit(b).alias("dy"), F.lit(a).alias("dx")) for b in (0, 1) for a in (0, 1)]))
    corners = at.withColumn("k", corner).select(
        "line_id", "dataset_id", "i", (c("px") - c("ix")).alias("fx"), (c("py") - c("iy")).alias("fy"), "k",
        F.least(c("ix") + c("k.dx"), c("w") - 1).alias("x"), F.least(c("iy") + c("k.dy"), c("h") - 1).alias("y"))
    asked = lines.agg(F.sum(F.col("samples").cast("long"))).first()[0] or 0
    if 4 * asked <= CORNER_ROWS:
        corners = F.broadcast(corners)
        pixels = images.pixels
    else:
        block = {"_by": floordiv(c("y"), TILE), "_bx": floordiv(c("x"), TILE)}
        passed = corners.select("dataset_id", *[v.alias(k) for k, v in block.items()]).distinct()
        pixels = images.pixels.withColumns(block).join(passed, ["dataset_id", "_by", "_bx"], "left_semi").drop("_by", "_bx")
    met = pixels.join(corners, ["dataset_id", "y", "x"])

    def pick(dy: int, dx: int):
        return F.max(F.when((c("k.dy") == dy) & (c("k.dx") == dx), c("z")))

    z = met.groupBy("line_id", "i").agg(
        pick(0, 0).alias("z00"), pick(0, 1).alias("z10"), pick(1, 0).alias("z01"), pick(1, 1).alias("z11"),
        F.first("fx").alias("fx"), F.first("fy").alias("fy"), F.min(finite(c("z"))).alias("ok"))
    # differences of neighbouring samples stay in single precision, the rest is double
    top = c("z00") + c("fx") * (c("z10") - c("z00"))
    bottom = c("z01") + c("fx") * (c("z11") - c("z01"))
    value = F.when(c("ok"), (top + c("fy") * (bottom - top)).cast("float")).otherwise(nan().cast("float"))
    samples = z.select(c("line_id").alias("dataset_id"), "i", value.alias("z"))
    scale = scale_of(c("ax.unit"))
    dx = (c("x1") - c("x0")) * c("ax.step") * scale
    dy = (c("y1") - c("y0")) * c("ay.step") * scale_of(c("ay.unit"))
    step = F.sqrt(dx * dx + dy * dy) / scale / (c("samples") - 1)
    scans = live.select(c("line_id").alias("dataset_id"), F.lit("LineProfile").alias("kind"),
                        axis("Distance", c("ax.unit"), c("samples"), step=step).alias("x"), "channel",
                        c("dataset_id").alias("parent_id"))
    return CurveSet(scans, samples=samples)
