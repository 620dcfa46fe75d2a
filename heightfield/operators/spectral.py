"""Line-average power spectral density and 2-D Fourier filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.units import is_length
from heightfield.model import CurveSet, ImageSet, axis
from heightfield.plans.layout import tile_pixels
from heightfield.plans.lines import BLOCK, attach_lines, blocks, lines_of, listed

FOURIER_KINDS = ("LowPass", "HighPass", "BandPass", "BandStop")


def pow2(n: int) -> int:
    return 1 << max(int(n) - 1, 0).bit_length()


def pow2_expr(n):
    """Next power of two of an integer column."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1e-12)).cast("int")


def line_psd(images: ImageSet) -> DataFrame:
    """(dataset_id, k, frequency, psd, rows_used): one-sided line-average spectrum along X, DC dropped.

    Lines with a non-finite sample are skipped.  Packed lines are transformed where they lie and summed per image and task, so
    what is exchanged is one spectrum per image and batch.  Images narrower than two pixels or without a length X axis are left out.
    """
    kept = images.among(images.scans.filter((F.col("x.count") >= 2) & is_length(F.col("x.unit"))))
    key = images.pixels.schema["dataset_id"].dataType.simpleString()

    def power(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, used, spectra = [], [], []
            for at, lines in blocks(b):
                lines = lines[np.isfinite(lines).all(axis=1)].astype(np.float64)
                m = pow2(lines.shape[1])
                s = np.fft.rfft(lines - lines.mean(axis=1, keepdims=True), m, axis=1)[:, 1:] if len(lines) else np.zeros((1, m // 2))
                first.append(at)
                used.append(len(lines))
                spectra.append((s.real ** 2 + s.imag ** 2).sum(axis=0))
            if first:
                ends = np.concatenate([[0], np.cumsum([len(s) for s in spectra])])
                yield pa.RecordBatch.from_arrays([b.column("dataset_id").take(pa.array(first)), pa.array(used, pa.int64()), listed(ends, np.concatenate(spectra))],
                                                 names=["dataset_id", "used", "power"])

    parts = lines_of(kept).select("dataset_id", "z").mapInArrow(power, f"dataset_id {key}, used long, power array<double>")
    parts = parts.select("dataset_id", F.struct("used", "power").alias("s"))
    sums = (parts.select("dataset_id", F.col("s.used").alias("used"), F.posexplode("s.power").alias("k", "v"))
            .groupBy("dataset_id", (F.col("k") + 1).alias("k")).agg(F.sum("v").alias("total"), F.sum("used").alias("used")))
    g = kept.geometry(dx=F.abs(F.col("x.step")))
    c = F.col
    m = pow2_expr(c("w"))
    mean_power = F.when(c("used") > 0, c("total") / F.greatest(c("used"), F.lit(1))).otherwise(F.lit(0.0))
    sided = F.when(c("k") < m / 2, 2.0 * mean_power).otherwise(mean_power)
    return sums.join(g, "dataset_id").select(
        "dataset_id", "k", (c("k") / (m * c("dx"))).alias("frequency"),
        (c("dx") / c("w") * sided).alias("psd"), c("used").alias("rows_used"))


def psd_curves(images: ImageSet) -> CurveSet:
    """The spectra as a curve collection: axis "Frequency" in 1/x, first sample at one step."""
    spectra = line_psd(images)
    m = pow2_expr(F.col("x.count"))
    step = 1.0 / (m * F.abs(F.col("x.step")))
    unit = F.concat(F.col("channel.unit"), F.lit("²·"), F.col("x.unit"))
    scans = images.scans.filter((F.col("x.count") >= 2) & is_length(F.col("x.unit"))).select(
        "dataset_id", F.lit("LineProfile").alias("kind"),
        axis("Frequency", F.concat(F.lit("1/"), F.col("x.unit")), (m / 2).cast("int"), origin=step, step=step).alias("x"),
        F.col("channel").withField("unit", unit).alias("channel"))
    samples = spectra.select("dataset_id", (F.col("k") - 1).alias("i"), F.col("psd").cast("float").alias("z"))
    return CurveSet(scans, samples=samples, known_rows=images.rows_if_known)


def psd_warnings(images: ImageSet) -> DataFrame:
    """(dataset_id, code): lines skipped, or no usable line at all."""
    lines = images.pixels.groupBy("dataset_id", "y").agg(
        F.max((~(F.abs("z") < float("inf"))).cast("int")).alias("bad"))
    per = lines.groupBy("dataset_id").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    return per.filter("bad > 0").select(
        "dataset_id", F.when(F.col("bad") == F.col("n"), "psd.empty").otherwise("psd.skipped-lines").alias("code"))


def passes(kind: str, r: np.ndarray, low: float, high: float) -> np.ndarray:
    if kind == "LowPass":
        return r <= high
    if kind == "HighPass":
        return r >= low
    if kind == "BandPass":
        return (r >= low) & (r <= high)
    return (r < low) | (r > high)


def fourier_filter(images: ImageSet, kind: str = "LowPass", low: float = 0.1, high: float = 0.5,
                   block: int = BLOCK) -> ImageSet:
    """Ideal radial filter on the mean-padded power-of-two grid.

    Row-column transform: packed lines are transformed where they lie and cut into strips, the strips of one column block meet
    for the column transform, mask and inverse, then travel back in blocks of lines.  A task holds one block (about
    ``block`` samples, never less than one full line or column), not an image.  Real input needs only the non-negative row
    frequencies.
    """
    if kind not in FOURIER_KINDS:
        raise ValueError(f"unknown Fourier filter {kind!r}")
    if not (0 <= low <= 1 and 0 <= high <= 1):
        raise ValueError("cutoffs must be 0 to 1")
    if kind in ("BandPass", "BandStop") and not low < high:
        raise ValueError("the low cutoff must be below the high cutoff")
    c = F.col
    mean = images.pixels.groupBy("dataset_id").agg(F.avg(c("z").cast("double")).alias("mean"))
    per = images.geometry().join(mean, "dataset_id").select(
        "dataset_id", "w", "h", "mean",
        F.greatest(F.lit(1), F.floor(F.lit(block) / c("w"))).cast("int").alias("rb"),
        F.greatest(F.lit(1), F.floor(F.lit(block) / pow2_expr(c("h")))).cast("int").alias("cb"))
    keep = ("w", "h", "mean", "rb", "cb")
    rows = attach_lines(images, lines_of(images), per)
    key = images.pixels.schema["dataset_id"].dataType.simpleString()

    def forward_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, lines in blocks(b):
                m, (count, w), cb = pow2(lines.shape[1]), lines.shape, b.column("cb")[first].as_py()
                padded = np.full((count, m), b.column("mean")[first].as_py())
                padded[:, :w] = lines
                spectrum = np.fft.rfft(padded, axis=1)
                own = b.slice(first, count)
                for u in range(-(-spectrum.shape[1] // cb)):
                    strip = spectrum[:, u * cb:(u + 1) * cb]
                    at = np.arange(count + 1) * strip.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [own.column("dataset_id"), own.column("y"), *(own.column(k) for k in keep), pa.array(np.full(count, u, np.int32)),
                         pa.StructArray.from_arrays([listed(at, strip.real.ravel()), listed(at, strip.imag.ravel())], names=["re", "im"])],
                        names=["dataset_id", "y0", *keep, "u", "s"])

    strips = rows.select("dataset_id", "y", "z", *keep).mapInArrow(
        forward_rows, f"dataset_id {key}, y0 int, w int, h int, mean double, rb int, cb int, u int, s struct<re:array<double>,im:array<double>>")
    columns = strips.groupBy("dataset_id", "u", *keep).agg(
        F.sort_array(F.collect_list(F.struct("y0", c("s.re").alias("re"), c("s.im").alias("im")))).alias("parts"))
    columns = columns.select("dataset_id", "u", *keep, F.flatten("parts.re").alias("re"), F.flatten("parts.im").alias("im"))

    @pandas_udf("array<struct<y0:int,re:array<double>,im:array<double>>>")
    def columns_masked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([mask_columns(*v) for v in zip(*cols)], dtype=object)

    def mask_columns(re, im, u, w, h, average, rb, cb):
        m, n = pow2(w), pow2(h)
        first = u * cb
        wide = min(cb, m // 2 + 1 - first)
        grid = np.zeros((n, wide), dtype=np.complex128)
        grid[:h] = (re + 1j * im).reshape(h, wide)
        if first == 0:
            grid[h:, 0] = average * m  # padding rows are constant: only their DC bin is non-zero
        spectrum = np.fft.fft(grid, axis=0)
        fv = np.fft.fftfreq(n) * 2.0 if n > 1 else np.zeros(1)
        fu = (first + np.arange(wide)) / (m / 2.0) if m > 1 else np.zeros(wide)
        radius = np.sqrt(fv[:, None] ** 2 + fu[None, :] ** 2) / np.sqrt(2.0)
        back = np.fft.ifft(np.where(passes(kind, radius, low, high), spectrum, 0.0), axis=0)[:h]
        return [{"y0": y, "re": back[y:y + rb].real.ravel(), "im": back[y:y + rb].imag.ravel()} for y in range(0, h, rb)]

    returned = columns.select("dataset_id", "u", "w", "h", "rb", "cb", F.explode(
        columns_masked("re", "im", "u", "w", "h", "mean", "rb", "cb")).alias("s"))
    lines = returned.groupBy("dataset_id", c("s.y0").alias("y0"), "w", "h", "rb", "cb").agg(
        F.sort_array(F.collect_list(F.struct("u", c("s.re").alias("re"), c("s.im").alias("im")))).alias("parts"))

    @pandas_udf("array<float>")
    def inverse_rows(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([join_rows(*v) for v in zip(*cols)], dtype=object)

    def join_rows(re, im, y0, w, h, rb, cb):
        m, count = pow2(w), min(rb, h - y0)
        pieces = [(np.asarray(a) + 1j * np.asarray(b)).reshape(count, -1) for a, b in zip(re, im)]
        return np.fft.irfft(np.concatenate(pieces, axis=1), m, axis=1)[:, :w].astype(np.float32).ravel()

    out = lines.select("dataset_id", "y0", F.lit(0).alias("x0"), c("w").alias("cw"),
                       inverse_rows("parts.re", "parts.im", "y0", "w", "h", "rb", "cb").alias("out"))
    return images.with_pixels(tile_pixels(out, "out"))
