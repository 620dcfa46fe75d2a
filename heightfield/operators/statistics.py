"""Summary moments, histograms, roughness parameters and rank-free reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import finite, floordiv, nan, ratio
from heightfield.model import CurveSet, ImageSet
from heightfield.plans.iterate import cut
from heightfield.plans.layout import CHUNK, attach, attach_salted

FAN = 4096  # chunks merged together
POINTS = 5  # fixed value: peaks and valleys averaged by the bounded point-average roughness


def moments(rows: DataFrame, keys: tuple[str, ...] = ("dataset_id",), value: str = "z",
            attach_mean: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Two-pass moments per key: n, lo, hi, p2p, mid, mean, sa, sq, skew, kurt (population, about the mean).

    Both passes are hash aggregates with map-side combine; between them only one row per key
    travels.  Without ``attach_mean`` the join back is salted by the value.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    first = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    joined = attach_mean(rows, first) if attach_mean else attach_salted(rows, first, tuple(keys), v)
    d = v - F.col("mean")
    second = joined.select(*keys, "n", "mean", "lo", "hi", d.alias("d"), (d * d).alias("d2")).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("mean").alias("mean"),
        F.avg(F.abs("d")).alias("sa"), F.avg("d2").alias("m2"),
        F.avg(F.col("d2") * F.col("d")).alias("m3"), F.avg(F.col("d2") * F.col("d2")).alias("m4"))
    return _named_moments(second, keys)


def _named_moments(second: DataFrame, keys: list[str]) -> DataFrame:
    lo = F.when(F.isnan("hi"), nan()).otherwise(F.col("lo"))  # a NaN anywhere makes both extremes NaN
    sq = F.sqrt("m2")
    return second.select(
        *keys, "n", lo.alias("lo"), "hi", (F.col("hi") - lo).alias("p2p"), ((lo + F.col("hi")) / 2).alias("mid"),
        "mean", "sa", sq.alias("sq"), ratio(F.col("m3"), sq * F.col("m2")).alias("skew"),
        ratio(F.col("m4"), F.col("m2") * F.col("m2")).alias("kurt"))


def image_moments(images: ImageSet) -> DataFrame:
    return moments(images.pixels, attach_mean=lambda rows, first: attach(images, rows, first))


def curve_moments(curves: CurveSet, rows: DataFrame | None = None) -> DataFrame:
    rows = curves.samples if rows is None else rows
    return moments(rows, attach_mean=lambda r, first: attach(curves, r, first))


def finite_range(rows: DataFrame, keys: tuple[str, ...] = ("dataset_id",), value: str = "z") -> DataFrame:
    """Finite minimum and maximum per key; keys without a finite value are absent."""
    return rows.filter(finite(F.col(value))).groupBy(*keys).agg(
        F.min(F.col(value).cast("double")).alias("lo"), F.max(F.col(value).cast("double")).alias("hi"))


def histogram(images: ImageSet, bins: int = 256) -> DataFrame:
    """Uniform bins over the finite range: dataset_id, bin, lo, hi, center, n.  Flat images have no histogram."""
    spans = finite_range(images.pixels).filter(F.col("hi") > F.col("lo"))
    width = (F.col("hi") - F.col("lo")) / bins
    hit = F.least(F.floor((F.col("z").cast("double") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (attach(images, images.pixels.filter(finite(F.col("z"))), spans)
              .groupBy("dataset_id", hit.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    slots = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    left = F.col("lo") + F.col("bin") * width
    return slots.join(counts, ["dataset_id", "bin"], "left").select(
        "dataset_id", "bin", left.alias("lo"), (left + width).alias("hi"),
        (F.col("lo") + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def point_average(rows: DataFrame, chunk: int = CHUNK, longest: int | None = None) -> DataFrame:
    """Bounded point-average roughness of (dataset_id, p, d): d is the residue at sequence position p.

    Runs of equal sign are found inside chunks of the sequence.  A chunk hands on its best
    POINTS complete runs of each sign and its first and last run, the only ones that can
    continue elsewhere, so the merge sees a dozen rows per chunk, not the sequence.
    Sequences of more than FAN chunks (``longest`` samples) are merged FAN units at a time.
    """
    return _best_points(_unit_runs(rows, chunk), chunk, longest)


def _unit_runs(rows: DataFrame, chunk: int, extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per chunk: its runs, and aggregates ``extra`` of its rows."""
    c = F.col
    unit = floordiv(c("p"), chunk)
    packed = rows.groupBy("dataset_id", unit.alias("c")).agg(
        F.collect_list((c("p") - unit.cast("long") * chunk).cast("int")).alias("p"), F.collect_list("d").alias("d"), *extra)

    @pandas_udf("array<struct<run:int,up:boolean,ext:double>>")
    def runs_of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([_chunk_runs(*v) for v in zip(*cols)], dtype=object)

    return packed.withColumn("runs", runs_of("p", "d")).drop("p", "d")


def _best_points(units: DataFrame, chunk: int, longest: int | None) -> DataFrame:
    c = F.col
    runs = units.select("dataset_id", "c", F.explode("runs").alias("r")).select("dataset_id", "c", "r.*")
    done, ends = _complete_runs(runs)
    unit = chunk
    while longest is not None and longest > unit * FAN:
        unit *= FAN
        inner, ends = _complete_runs(_joined_runs(ends, F.floor(c("c") / FAN).cast("int")))
        done = done.unionByName(inner)
    merged = _joined_runs(ends, F.lit(0)).select("dataset_id", "up", "ext")
    best = Window.partitionBy("dataset_id", "up").orderBy(F.when(c("up"), -c("ext")).otherwise(c("ext")))
    top = done.unionByName(merged).withColumn("rk", F.row_number().over(best)).filter(c("rk") <= POINTS)
    agg = top.groupBy("dataset_id").agg(
        F.count(F.when(c("up"), 1)).alias("ups"), F.count(F.when(~c("up"), 1)).alias("downs"),
        F.sum(F.when(c("up"), c("ext")).otherwise(-c("ext"))).alias("s"))
    return agg.select("dataset_id", F.when(
        (c("ups") >= POINTS) & (c("downs") >= POINTS), c("s") / POINTS).otherwise(nan()).alias("rz_points"))


def _chunk_runs(p: np.ndarray, d: np.ndarray) -> list[dict]:
    d = d[np.argsort(p)]
    up = d > 0
    starts = np.concatenate([[0], np.flatnonzero(up[1:] != up[:-1]) + 1])
    rising = up[starts]
    ext = np.where(rising, np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts))
    inner = np.arange(1, len(starts) - 1)
    best = [k[np.argsort(sign * ext[k])[:POINTS]] for sign, k in ((-1, inner[rising[inner]]), (1, inner[~rising[inner]]))]
    keep = np.unique(np.concatenate([[0, len(starts) - 1], *best]).astype(int))
    return [{"run": int(k), "up": bool(rising[k]), "ext": float(ext[k])} for k in keep]


def _complete_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs of a unit that end inside it, and its first and last run, which may continue outside."""
    runs = runs.withColumn("last", F.max("run").over(Window.partitionBy("dataset_id", "c")))
    at_end = (F.col("run") == 0) | (F.col("run") == F.col("last"))
    return runs.filter(~at_end).select("dataset_id", "up", "ext"), runs.filter(at_end).select("dataset_id", "c", "run", "up", "ext")


def _joined_runs(ends: DataFrame, unit) -> DataFrame:
    """Join end runs that continue into the next unit; the units are numbered within larger ones."""
    c = F.col
    along = Window.partitionBy("dataset_id", "u").orderBy("c", "run")
    parted = (F.lag("c").over(along) == c("c")) | (F.lag("up").over(along) != c("up"))
    return (ends.withColumn("u", unit).withColumn("cut", F.coalesce(parted.cast("int"), F.lit(0)))
            .withColumn("g", F.sum("cut").over(along))
            .groupBy("dataset_id", c("u").alias("c"), c("g").alias("run"), "up")
            .agg(F.when(c("up"), F.max("ext")).otherwise(F.min("ext")).alias("ext")))


def image_point_average(images: ImageSet, chunk: int = CHUNK) -> DataFrame:
    """Bounded point-average roughness of each image in row-major order; a non-finite pixel makes it NaN.

    A non-finite mean leaves no residue above zero (or only undefined ones below), so the
    result is NaN without a separate test.
    """
    mean = images.pixels.groupBy("dataset_id").agg(F.avg(F.col("z").cast("double")).alias("mean"))
    per = mean.join(images.geometry(), "dataset_id").select("dataset_id", "w", "mean")
    rows = attach(images, images.pixels, per).select(
        "dataset_id", (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("p"),
        (F.col("z").cast("double") - F.col("mean")).alias("d"))
    return point_average(rows, chunk, images.largest)


# Measurement names of the image statistics operation.
STATISTICS = ("min", "max", "peakToPeak", "mid", "mean", "meanAbsoluteDeviation", "rms",
              "boundedPointAverageRoughness", "skewness", "kurtosis", "count")


def image_statistics(images: ImageSet) -> DataFrame:
    """Eleven scalars per image as (dataset_id, name, value)."""
    # two passes over the pixels: means, then everything about the mean by chunks of the row-major sequence
    c = F.col
    v = c("z").cast("double")
    first = cut(images.pixels.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")))
    per = first.join(images.geometry(), "dataset_id").select("dataset_id", "w", "mean")
    rows = attach(images, images.pixels, per).select(
        "dataset_id", (c("y").cast("long") * c("w") + c("x")).alias("p"), (v - c("mean")).alias("d"))
    d2 = c("d") * c("d")
    sums = {"sa": F.abs("d"), "m2": d2, "m3": d2 * c("d"), "m4": d2 * d2}
    units = cut(_unit_runs(rows, CHUNK, tuple(F.sum(e).alias(k) for k, e in sums.items())))
    total = units.groupBy("dataset_id").agg(*[F.sum(k).alias(k) for k in sums])
    wide = first.join(total, "dataset_id").select("dataset_id", "n", "lo", "hi", "mean", *[(c(k) / c("n")).alias(k) for k in sums])
    wide = _named_moments(wide, ["dataset_id"]).join(_best_points(units, CHUNK, images.largest), "dataset_id", "left")
    cols = ["lo", "hi", "p2p", "mid", "mean", "sa", "sq", "rz_points", "skew", "kurt", "n"]
    return unpivot(wide, dict(zip(STATISTICS, cols)))


def unpivot(wide: DataFrame, names: dict[str, str], keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    args = ", ".join(f"'{name}', CAST({col} AS DOUBLE)" for name, col in names.items())
    return wide.selectExpr(*keys, f"stack({len(names)}, {args}) AS (name, value)")


def areal(stats: DataFrame, *keys: str) -> DataFrame:
    """Areal parameter names over a moments table."""
    c = F.col
    return stats.select(*keys, c("sq").alias("Sq"), c("sa").alias("Sa"), (c("hi") - c("mean")).alias("Sp"),
                        (c("mean") - c("lo")).alias("Sv"), c("p2p").alias("Sz"),
                        c("skew").alias("Ssk"), c("kurt").alias("Sku"))


def profile(stats: DataFrame, *keys: str) -> DataFrame:
    """Profile parameter names over a moments table."""
    c = F.col
    return stats.select(*keys, c("sa").alias("Ra"), c("sq").alias("Rq"), (c("hi") - c("mean")).alias("Rp"),
                        (c("mean") - c("lo")).alias("Rv"), c("p2p").alias("Rz"),
                        c("skew").alias("Rsk"), c("kurt").alias("Rku"))


def areal_roughness(images: ImageSet) -> DataFrame:
    """Sq, Sa, Sp, Sv, Sz, Ssk, Sku per image; a non-finite pixel poisons the image."""
    return areal(image_moments(images), "dataset_id")


def curve_roughness(curves: CurveSet) -> DataFrame:
    """Ra, Rq, Rp, Rv, Rz, Rsk, Rku per curve over its finite samples; NaN where none is finite."""
    stats = curve_moments(curves, curves.samples.filter(finite(F.col("z"))))
    return fill_missing(profile(stats, "dataset_id"), curves.scans.select("dataset_id"))


def fill_missing(values: DataFrame, keys: DataFrame, counts: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: NaN (0 for ``counts``) where the reduction saw no rows."""
    on = keys.columns
    rest = [c for c in values.columns if c not in on]
    return keys.join(values, on, "left").select(
        *on, *[F.coalesce(c, F.lit(0) if c in counts else nan()).alias(c) for c in rest])


def column_mean(images: ImageSet, along: str = "x") -> DataFrame:
    """Average over the other axis at each position: dataset_id, i, mean."""
    return images.pixels.groupBy("dataset_id", F.col(along).alias("i")).agg(F.avg(F.col("z").cast("double")).alias("mean"))
