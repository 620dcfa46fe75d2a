"""Gaussian profile and areal filters, and the roughness parameters taken after them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import GAUSS_ALPHA, INF, NAN, finite, floordiv, gauss_reach, total
from heightfield.functions.regions import Region
from heightfield.functions.units import is_length, scale_of
from heightfield.model import CurveSet, ImageSet, fitting
from heightfield.operators.regions import masked_pixels, region_moments, region_table
from heightfield.operators.statistics import areal, curve_moments, fill_missing, image_moments, profile
from heightfield.plans.layout import (CHUNK, TILE, attach, chunk_samples, halo_chunks, halo_tiles, tile_pixels,
                                      with_curve_geometry)
from heightfield.plans.lines import attach_lines, lines_of, mapped

BANDS = ("Roughness", "Waviness")
SAMPLING_LENGTHS = 5  # fixed value: standard number of sampling lengths


def gaussian_weights(sigma: float, reach: int) -> tuple[np.ndarray, float]:
    """Half kernel at 0..reach for a Gaussian of ``sigma`` samples, and the sum of the full kernel."""
    k = np.arange(reach + 1, dtype=np.float64)
    w = np.exp(-np.pi / (sigma * sigma) * k * k)
    return w, w[0] + 2.0 * w[1:].sum()


def mirror(index: np.ndarray, n: int) -> np.ndarray:
    """Reflect indices into 0..n-1 about both end samples, any number of times."""
    last = n - 1
    if not last:
        return np.zeros_like(index)
    return last - np.abs(last - np.mod(index, 2 * last))


def smooth_rows(rows: np.ndarray, weights: np.ndarray, norm: float) -> np.ndarray:
    """Symmetric smoothing of each row, dropping a margin of one kernel half on both sides.

    Mirror samples are paired in the precision of ``rows`` before weighting: single for
    stored samples, double for a surface that has already been smoothed along its other axis.
    """
    reach, n = len(weights) - 1, rows.shape[1] - 2 * (len(weights) - 1)
    with np.errstate(invalid="ignore"):
        out = weights[0] * rows[:, reach:reach + n].astype(np.float64)
        for k in range(1, reach + 1):
            out += weights[k] * (rows[:, reach - k:reach - k + n] + rows[:, reach + k:reach + k + n])
        return out / norm


def _cutoff_ok(cutoff: float) -> None:
    if not (np.isfinite(cutoff) and 0.0 < cutoff <= 1e9):
        raise ValueError("the cutoff wavelength must be positive and at most 1e9")


def _band_ok(band: str) -> None:
    if band not in BANDS:
        raise ValueError(f"unknown band {band!r}")


NOT_LENGTH = ("axis.not-length", "an axis is not a length")


def curve_rejects(cutoff: float, whole: bool = False) -> list[tuple[Column, str, str]]:
    """(condition, code, message) of curves a cutoff cannot apply to; ``whole`` asks for one full cutoff within the curve."""
    step = F.abs(F.col("x.step"))
    told = [(~is_length(F.col("x.unit")), *NOT_LENGTH),
            (F.lit(cutoff) < 2.0 * step, "cutoff.below-sampling", "the cutoff spans fewer than two samples")]
    if whole:
        told.append(((F.col("x.count") - 1) * step < cutoff, "cutoff.beyond-extent", "the cutoff is longer than the curve"))
    return told


def filterable_curves(curves: CurveSet, cutoff: float, whole: bool = False) -> DataFrame:
    """Catalog rows a cutoff applies to: length abscissa, at least two samples per cutoff."""
    return fitting(curves.scans, curve_rejects(cutoff, whole))


def gaussian_filter(curves: CurveSet, band: str = "Roughness", cutoff: float = 0.8, chunk: int = CHUNK) -> CurveSet:
    """Split each curve at wavelength ``cutoff`` (in its X unit); curves the cutoff cannot apply to are left out.

    A kernel shorter than its curve smooths chunk by chunk; one that reaches over the whole curve is folded onto the
    period of the reflected curve, so its length costs nothing.  One small job over the catalog tells which curves are which.
    """
    _cutoff_ok(cutoff)
    _band_ok(band)
    scans = filterable_curves(curves, cutoff)
    folds = 4.0 * GAUSS_ALPHA * cutoff / F.abs(F.col("x.step")) >= F.col("x.count") - 1
    rows, folded = scans.agg(F.count(F.lit(1)), F.count(F.when(folds, 1))).first()
    kept = CurveSet(scans, samples=curves.samples, known_rows=rows)
    parts = []
    if folded:
        parts.append(_by_period(CurveSet(scans.filter(folds), samples=curves.samples, known_rows=folded), band, cutoff))
    if folded < rows or not parts:
        parts.append(_by_chunks(CurveSet(scans.filter(~folds), samples=curves.samples, known_rows=rows - folded), band, cutoff, chunk))
    return kept.with_samples(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def _by_chunks(curves: CurveSet, band: str, cutoff: float, chunk: int) -> DataFrame:
    reach = gauss_reach(cutoff, F.abs(F.col("x.step")))
    rows = with_curve_geometry(curves, reach=reach, size=F.greatest(F.lit(chunk), reach))
    packed = halo_chunks(rows, reach=F.col("reach"), size=F.col("size"), carry=("reach", "size", "dx"))

    @pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([one(*v) for v in zip(*cols)], dtype=object)

    def one(p, z, i0, cn, a, wn, n, reach, dx):
        line = np.full(wn, np.nan, dtype=np.float32)
        line[p] = z
        at = mirror(np.arange(i0 - reach, i0 + cn + reach), n) - a
        mean = smooth_rows(line[at][None, :], *gaussian_weights(GAUSS_ALPHA * cutoff / dx, reach))[0]
        with np.errstate(invalid="ignore"):
            out = mean if band == "Waviness" else line[i0 - a:i0 - a + cn] - mean
        return out.astype(np.float32)

    out = packed.withColumn("out", run("p", "z", "i0", "cn", "a", "wn", "n", "reach", "dx"))
    return chunk_samples(out, "out")


# Cosines of the reflected curve that a kernel reaching over the curve still passes: the next is damped by exp(-pi * 30^2 / 64).
COSINES = 30


def _by_period(curves: CurveSet, band: str, cutoff: float) -> DataFrame:
    """The mean line of a kernel that reaches over the whole curve.

    A reflected curve repeats after 2 (n - 1) samples, so it is a sum of n cosines, and a symmetric kernel only scales each of them.
    A kernel this long leaves a handful: their amplitudes are plain sums over the samples, with map-side combine, whatever
    the length of the curve or the cutoff.  Every output sees every sample, so one that is not finite reaches all of them.
    """
    c = F.col
    last = F.greatest(c("n") - 1, F.lit(1)).cast("double")
    turn = F.lit(np.pi) * c("i") / last
    z = c("z").cast("double")
    weight = F.when((c("i") == 0) | (c("i") == c("n") - 1), 1.0).otherwise(2.0) * F.when(finite(z), z).otherwise(0.0)
    rows = with_curve_geometry(curves)
    sums = rows.groupBy("dataset_id", "n", "dx").agg(
        *[F.sum(weight * F.cos(j * turn)).alias(f"s{j}") for j in range(COSINES)], F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.isnan("z"), 1)).alias("nans"), F.count(F.when(z == F.lit(INF), 1)).alias("ups"), F.count(F.when(z == F.lit(-INF), 1)).alias("downs"))
    sigma = F.lit(GAUSS_ALPHA * cutoff) / c("dx")
    period = F.greatest(2 * (c("n") - 1), F.lit(1)).cast("double")

    def passed(frequency):
        """Sum over the kernel's samples at a frequency, up to a factor common to all frequencies."""
        return F.aggregate(F.sequence(F.lit(-4), F.lit(4)), F.lit(0.0), lambda s, m: s + F.exp(-np.pi * F.pow(sigma * (frequency + m), F.lit(2.0))))

    def amplitude(s, j):
        both = F.when((j == 0) | (c("n") - 1 == j), 1.0).otherwise(2.0)
        return F.when(c("n") > j, passed(j / period) / passed(F.lit(0.0)) * both / period * s).otherwise(0.0)

    spoilt = (c("nans") > 0) | ((c("ups") > 0) & (c("downs") > 0)) | (c("rows") < c("n"))
    level = F.when(spoilt, NAN).when(c("ups") > 0, INF).when(c("downs") > 0, -INF)
    lines = sums.select("dataset_id", level.alias("level"), F.transform(F.array(*[f"s{j}" for j in range(COSINES)]), amplitude).alias("c"))
    mean = F.coalesce("level", total([c("c")[j] * F.cos(j * turn) for j in range(COSINES)]))
    out = mean if band == "Waviness" else z - mean
    return attach(curves, rows, lines).select("dataset_id", "i", out.cast("float").alias("z"))


def evaluation_window(n: Column, dx: Column, cutoff: float, lengths: int = SAMPLING_LENGTHS) -> dict[str, Column]:
    """Centred window of whole sampling lengths: start, length (samples) and sampling_lengths; 0 when none fits."""
    fit = F.least(F.lit(lengths), F.floor((n - 1) * dx / cutoff)).cast("int")
    steps = F.least(n - 1, F.floor(fit * cutoff / dx)).cast("int")
    return {
        "start": F.when(fit < 1, F.lit(0)).otherwise(F.floor((n - (steps + 1)) / 2)).cast("int"),
        "length": F.when(fit < 1, F.lit(0)).otherwise(steps + 1).cast("int"),
        "sampling_lengths": F.greatest(fit, F.lit(0)),
    }


def filtered_curve_roughness(curves: CurveSet, cutoff: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """R-parameters of the roughness profile over the evaluation window, plus the window itself.

    Curves shorter than one cutoff are left out.
    """
    usable = CurveSet(filterable_curves(curves, cutoff, whole=True), samples=curves.samples, known_rows=curves.rows_if_known)
    rough = gaussian_filter(usable, "Roughness", cutoff, chunk)
    window = evaluation_window(F.col("x.count"), F.abs(F.col("x.step")), cutoff)
    rows = with_curve_geometry(rough, start=window["start"], length=window["length"])
    i = F.col("i")
    stats = curve_moments(rough, rows.filter(
        (i >= F.col("start")) & (i < F.col("start") + F.col("length")) & finite(F.col("z"))
    ).select("dataset_id", "i", "z"))
    values = fill_missing(profile(stats, "dataset_id"), usable.scans.select("dataset_id"))
    frame = usable.geometry(**window).select(
        "dataset_id", F.col("sampling_lengths").alias("SamplingLengths"),
        ((F.col("length") - 1) * F.col("dx")).alias("EvaluationLength"))
    return values.join(frame, "dataset_id")


def y_step_in_x_unit() -> Column:
    return F.abs(F.col("y.step")) * scale_of(F.col("y.unit")) / scale_of(F.col("x.unit"))


def image_rejects(cutoff: float) -> list[tuple[Column, str, str]]:
    """(condition, code, message) of images an areal cutoff cannot apply to."""
    dx, dy = F.abs(F.col("x.step")), y_step_in_x_unit()
    spans = F.least((F.col("x.count") - 1) * dx, (F.col("y.count") - 1) * dy)
    return [(~(is_length(F.col("x.unit")) & is_length(F.col("y.unit"))), *NOT_LENGTH),
            (F.lit(cutoff) < 2.0 * F.greatest(dx, dy), "cutoff.below-sampling", "the cutoff spans fewer than two samples"),
            (F.lit(cutoff) > spans, "cutoff.beyond-extent", "the cutoff is longer than the image")]


def filterable_images(images: ImageSet, cutoff: float) -> DataFrame:
    """Catalog rows an areal cutoff applies to: lengths on both axes, two samples or more, within both spans."""
    return fitting(images.scans, image_rejects(cutoff))


def gaussian_areal_filter(images: ImageSet, band: str = "Roughness", cutoff: float = 0.8, tile: int = TILE) -> ImageSet:
    """Separable Gaussian filter: packed lines are smoothed where they lie, one exchange of tiles with a Y margin follows.

    The X pass hands its unrounded sums to the Y pass; only the result is rounded to float.
    """
    _cutoff_ok(cutoff)
    _band_ok(band)
    rx = gauss_reach(cutoff, F.abs(F.col("x.step")))
    ry = gauss_reach(cutoff, y_step_in_x_unit())
    geometry = dict(rx=rx, ry=ry, dx=F.abs(F.col("x.step")), dy=y_step_in_x_unit(), th=F.greatest(F.lit(tile), ry))
    names = tuple(geometry)

    def along_x(block: np.ndarray, row: dict) -> np.ndarray:
        w, r = block.shape[1], row["rx"]
        return smooth_rows(block[:, mirror(np.arange(-r, w + r), w)], *gaussian_weights(GAUSS_ALPHA * cutoff / row["dx"], r))

    def along_y(p, z, mid, y0, ch, wy, wh, ww, h, r, d):
        block = np.full(wh * ww, np.nan)
        block[p] = mid
        at = mirror(np.arange(y0 - r, y0 + ch + r), h) - wy
        columns = np.ascontiguousarray(block.reshape(wh, ww)[at].T)
        mean = smooth_rows(columns, *gaussian_weights(GAUSS_ALPHA * cutoff / d, r)).T
        if band == "Roughness":
            own = np.full(wh * ww, np.nan)
            own[p] = z
            with np.errstate(invalid="ignore"):
                mean = own.reshape(wh, ww)[y0 - wy:y0 - wy + ch] - mean
        return mean.astype(np.float32).ravel()

    @pandas_udf("array<float>")
    def pass_y(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([along_y(*v) for v in zip(*cols)], dtype=object)

    c = F.col
    rows = attach_lines(images, lines_of(images), images.geometry(**geometry)).select("dataset_id", "y", "z", c("z").alias("own"), "w", "h", *names)
    mids = mapped(rows, along_x, "array<double>", same=("dataset_id",))
    between = mids.select("dataset_id", "y", "w", "h", *names, F.posexplode(F.arrays_zip(c("z").alias("mid"), c("own").alias("z"))).alias("x", "v"))
    between = between.select("dataset_id", "y", "x", c("v.z").alias("z"), c("v.mid").alias("mid"), "w", "h", *names)
    second = halo_tiles(between, reach_y=c("ry"), tile_h=c("th"), carry=names, also=("mid",))
    second = second.withColumn("out", pass_y("p", "z", "mid", "y0", "ch", "wy", "wh", "ww", "h", "ry", "dy"))
    return images.with_pixels(tile_pixels(second, "out"))


def filtered_roughness(images: ImageSet, cutoff: float = 0.8, regions: list[Region] | None = None,
                       tile: int = TILE) -> DataFrame:
    """Areal parameters of the filtered surface; regions restrict the evaluation, never the filter.

    Images the cutoff cannot apply to are left out.
    """
    usable = images.among(filterable_images(images, cutoff))
    rough = gaussian_areal_filter(usable, "Roughness", cutoff, tile)
    if regions is None:
        return areal(image_moments(rough), "dataset_id")
    table = region_table(rough, regions)
    stats = region_moments(rough, masked_pixels(rough, table), len(regions))
    return fill_missing(areal(stats, "dataset_id", "region_id"),
                        table.select("dataset_id", F.col("region.region_id").alias("region_id")))
