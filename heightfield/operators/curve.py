"""Curve operators: range statistics, smoothing, noise estimate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import finite, floordiv, nan, raw_to_real, ratio
from heightfield.model import CurveSet
from heightfield.operators.statistics import fill_missing
from heightfield.plans.iterate import cut
from heightfield.plans.layout import CHUNK, attach, attach_salted, chunk_samples, halo_chunks, with_curve_geometry

# MAD to sigma of a normal distribution, and the second-difference gain.
MAD_TO_SIGMA = 1.482602
SECOND_DIFFERENCE = float(np.sqrt(6.0))


def single(a: Column, b: Column) -> Column:
    """Sum of two samples in single precision, the precision samples are stored in."""
    return (a.cast("float") + b.cast("float")).cast("double")


def range_statistics(curves: CurveSet, start: int = 0, count: int = 128) -> DataFrame:
    """RangeMin/Max/Mean/Rms, PeakValue, PeakPosition, Area, Centroid, Fwhm over a sample range.

    The range is packed by chunks with one neighbour on either side, in one exchange that both passes read: the first sums up
    each chunk, the second looks up, from the level the first has set, the stopping sample nearest the first maximum on each side
    together with its neighbour.  What travels between them is one row per chunk and curve.
    """
    if start < 0 or count < 1:
        raise ValueError("start must not be negative and count must be positive")
    c = F.col
    live = CurveSet(curves.scans.filter(c("x.count") > start), samples=curves.samples, known_rows=curves.rows_if_known)
    table = live.scans.select("dataset_id", (F.least(F.lit(start + count), c("x.count")) - start).alias("n"))
    ranged = live.samples.filter((c("i") >= start) & (c("i") < start + count)).withColumn("i", c("i") - start)
    packed = halo_chunks(attach(live, ranged, table), reach=1, size=CHUNK)

    @pandas_udf("struct<n:long,lo:double,hi:double,at:int,sum:double,sumi:double,z0:double,z1:double>")
    def summed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame([total(*v) for v in zip(*cols)])

    def total(p, z, wn, a, i0, cn, n):
        core = _line(p, z, wn)[i0 - a:i0 - a + cn]
        ok = np.flatnonzero(np.isfinite(core))
        v = core[ok]
        at = int(ok[np.argmax(v)]) if v.size else -1
        return {"n": v.size, "lo": v.min(initial=np.inf), "hi": v.max(initial=-np.inf), "at": i0 + at, "sum": v.sum(), "sumi": (v * (i0 + ok)).sum(),
                "z0": core[0] if i0 == 0 else None, "z1": core[-1] if i0 + cn == n else None}

    @pandas_udf("struct<squares:double,ls:int,l0:double,l1:double,rs:int,r0:double,r1:double>")
    def met(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame([crossed(*v) for v in zip(*cols)]).astype({"ls": "Int32", "rs": "Int32"})

    def crossed(p, z, wn, a, i0, cn, hi, half, at, mean):
        line, first = _line(p, z, wn), i0 - a
        core = line[first:first + cn]
        ok = np.isfinite(core)
        stops = i0 + np.flatnonzero(~((core > half) & (core < hi)))
        left, right = stops[stops < at], stops[stops > at]
        out = {"squares": float(((core[ok] - mean) ** 2).sum()), "ls": None, "l0": None, "l1": None, "rs": None, "r0": None, "r1": None}
        if left.size:
            k = left[-1] - a
            out |= {"ls": int(left[-1]), "l0": line[k], "l1": line[k + 1]}
        if right.size:
            k = right[0] - a
            out |= {"rs": int(right[0]), "r0": line[k], "r1": line[k - 1]}
        return out

    window = ("p", "z", "wn", "a", "i0", "cn")
    s = packed.select("dataset_id", "n", summed(*window, "n").alias("s")).select("dataset_id", "n", "s.*")
    s = s.toDF("dataset_id", "length", "n", *s.columns[3:])
    peak = F.max(F.when(c("n") > 0, F.struct(c("hi").alias("v"), (-c("at")).alias("ni")))).alias("peak")
    one = s.groupBy("dataset_id", "length").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), peak, F.sum("sum").alias("sum"), F.sum("sumi").alias("sumi"),
                                                F.first("z0", ignorenulls=True).alias("z0"), F.first("z1", ignorenulls=True).alias("z1"))
    hi, at = c("peak.v"), -c("peak.ni")
    one = one.filter(c("n") > 0).select("dataset_id", "length", "n", "lo", "sum", "sumi", hi.alias("hi"), at.alias("at"), (c("sum") / c("n")).alias("mean"),
                                        single(c("z0"), c("z1")).alias("ends"), (hi - (hi - c("lo")) * 0.5).alias("half"))
    # one row per chunk on both sides, so a giant curve is no hot key
    levels = one.select("dataset_id", "hi", "half", "at", "mean", F.explode(F.sequence(F.lit(0), floordiv(c("length") - 1, CHUNK))).alias("c"))
    chunks = packed.select("dataset_id", "c", *window).join(levels, ["dataset_id", "c"])
    two = chunks.select("dataset_id", met(*window, "hi", "half", "at", "mean").alias("m")).select("dataset_id", "m.*").groupBy("dataset_id").agg(
        F.sum("squares").alias("squares"), F.max(F.when(c("ls").isNotNull(), F.struct("ls", "l0", "l1"))).alias("l"),
        F.min(F.when(c("rs").isNotNull(), F.struct("rs", "r0", "r1"))).alias("r"))
    out = one.join(two, "dataset_id").join(live.scans.select("dataset_id", c("x").alias("ax")), "dataset_id")
    left = c("l.ls") + (c("half") - c("l.l0")) / single(c("l.l1"), -c("l.l0"))
    right = c("r.rs") - 1 + (c("r.r1") - c("half")) / single(c("r.r1"), -c("r.r0"))
    inside = ((c("hi") > c("lo")) & (c("at") > 0) & (c("at") < c("length") - 1) & (c("l.l0") <= c("half")) & (c("r.r0") <= c("half")))
    dx = F.abs(c("ax.step"))
    moment = raw_to_real(c("ax"), F.lit(start)) * c("sum") + (raw_to_real(c("ax"), F.lit(1)) - raw_to_real(c("ax"), F.lit(0))) * c("sumi")
    values = out.select(
        "dataset_id", c("lo").alias("RangeMin"), c("hi").alias("RangeMax"), c("mean").alias("RangeMean"),
        F.sqrt(c("squares") / c("n")).alias("RangeRms"), c("hi").alias("PeakValue"), raw_to_real(c("ax"), c("at") + start).alias("PeakPosition"),
        F.when(c("length") == c("n"), dx * (c("sum") - c("ends") / 2)).otherwise(nan()).alias("Area"),
        ratio(moment, c("sum")).alias("Centroid"),
        F.when(inside, (right - left) * dx).otherwise(nan()).alias("Fwhm"))
    return fill_missing(values, live.scans.select("dataset_id"))


@lru_cache(maxsize=256)
def savgol_weights(width: int, order: int, at: int) -> np.ndarray:
    """Weights of the local least-squares polynomial over ``width`` samples, evaluated at sample ``at``.

    """
    basis = savgol_basis(width, order)
    return (basis.T @ basis[:, at]).astype(np.float64)


@lru_cache(maxsize=64)
def savgol_basis(width: int, order: int) -> np.ndarray:
    """Orthonormal polynomials of degree 0..order on ``width`` equally spaced samples (Gram polynomials), in extended precision."""
    x = np.arange(width, dtype=np.longdouble) - np.longdouble(width - 1) / 2
    n2, rows = np.longdouble(width) ** 2, [np.full(width, 1 / np.sqrt(np.longdouble(width)))]
    before, step = np.zeros(width, np.longdouble), np.longdouble(0)
    for k in range(1, order + 1):
        ahead = np.longdouble(k) / 2 * np.sqrt((n2 - k * k) / np.longdouble(4 * k * k - 1))
        rows.append((x * rows[-1] - step * before) / ahead)
        before, step = rows[-2], ahead
    return np.array(rows)


def smooth(curves: CurveSet, window: int = 5, order: int = 2, chunk: int = CHUNK) -> CurveSet:
    """Savitzky-Golay smoothing; windows shift inward at the ends and skip non-finite samples.

    Curves with no more samples than ``order`` are left out.
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 3")
    if not 0 <= order <= 8 or order >= window:
        raise ValueError("the order must be 0 to 8 and smaller than the window")
    kept = CurveSet(curves.scans.filter(F.col("x.count") > order), samples=curves.samples, known_rows=curves.rows_if_known)
    reach, size = window - 1, max(chunk, window)

    @pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series([one(*v) for v in zip(*cols)], dtype=object)

    def one(p, z, i0, cn, a, wn, n):
        line = np.full(wn, np.nan, dtype=np.float32)
        line[p] = z
        wide = min(window, n)
        i = np.arange(i0, i0 + cn)
        first = np.clip(i - window // 2, 0, n - wide)
        offset, wide_line = i - first, line.astype(np.float64)
        out = np.zeros(cn)
        inner = np.flatnonzero(offset == wide // 2)  # consecutive samples, all weighted alike
        with np.errstate(invalid="ignore"):
            if len(inner):
                begin = first[inner[0]] - a
                for k, weight in enumerate(savgol_weights(wide, order, wide // 2)):
                    out[inner] += weight * wide_line[begin + k:begin + k + len(inner)]
            for k in np.flatnonzero(offset != wide // 2):
                out[k] = savgol_weights(wide, order, int(offset[k])) @ wide_line[first[k] - a:first[k] - a + wide]
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(wide_line))])
        gaps = np.flatnonzero(bad[first - a + wide] > bad[first - a])
        basis = savgol_basis(wide, order).astype(np.float64).T
        views = np.lib.stride_tricks.sliding_window_view(wide_line, wide)
        few = max(1, (1 << 20) // (wide * (order + 1)))  # windows solved together
        for k in range(0, len(gaps), few):
            at = gaps[k:k + few]
            own = views[first[at] - a]
            good = np.isfinite(own)
            enough = good.sum(axis=1) > order
            out[at[~enough]] = line[i[at[~enough]] - a]
            at, own, good = at[enough], own[enough], good[enough]
            if len(at):
                q, r = np.linalg.qr(good[:, :, None] * basis[None])
                fit = np.linalg.solve(r, np.einsum("mwo,mw->mo", q, np.where(good, own, 0.0))[:, :, None])[:, :, 0]
                out[at] = (basis[offset[at]] * fit).sum(axis=1)
        return out.astype(np.float32)

    packed = halo_chunks(with_curve_geometry(kept), reach=reach, size=size)
    packed = packed.withColumn("out", run("p", "z", "i0", "cn", "a", "wn", "n"))
    return kept.with_samples(chunk_samples(packed, "out"))


def second_differences(line: np.ndarray) -> np.ndarray:
    """|2b - a - c| over the triples whose three samples are finite."""
    v = line.astype(np.float64)
    with np.errstate(invalid="ignore"):
        d = np.abs(2.0 * v[1:-1] - v[:-2] - v[2:])
    ok = np.isfinite(v)
    return d[ok[1:-1] & ok[:-2] & ok[2:]]


def noise(curves: CurveSet, chunk: int = CHUNK) -> DataFrame:
    """Noise sigma per curve (DER_SNR): (dataset_id, sigma); 0 without a finite triple.

    Curves that fit a chunk take their median there.  Otherwise the exact median is
    selected digit by digit on the bit patterns of the differences, with counts only.
    """
    if curves.longest <= chunk:
        @pandas_udf("double")
        def whole(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for p, z, wn in batches:
                yield pd.Series([_sigma(_line(*v)) for v in zip(p, z, wn)], dtype="float64")

        packed = halo_chunks(with_curve_geometry(curves), size=chunk)
        values = packed.select("dataset_id", whole("p", "z", "wn").alias("sigma"))
    else:
        @pandas_udf("array<bigint>")
        def patterns(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in batches:
                yield pd.Series([inner(*v) for v in zip(*cols)], dtype=object)

        def inner(p, z, wn, i0, cn, a):
            line = _line(p, z, wn)
            lo, hi = max(i0 - 1, a) - a, min(i0 + cn + 1, a + wn) - a
            return second_differences(line[lo:hi]).view(np.int64)

        packed = halo_chunks(with_curve_geometry(curves), reach=1, size=chunk)
        # every digit reads the differences again: keep them, packed, instead of exchanging the samples each time
        kept = cut(packed.select("dataset_id", patterns("p", "z", "wn", "i0", "cn", "a").alias("b")))
        bits = kept.select("dataset_id", F.explode("b").alias("b"))
        values = _median_of_bits(curves, bits).select(
            "dataset_id", (F.lit(MAD_TO_SIGMA) * F.col("median") / SECOND_DIFFERENCE).alias("sigma"))
    return curves.scans.select("dataset_id").join(values, "dataset_id", "left").select(
        "dataset_id", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def _line(p, z, wn) -> np.ndarray:
    line = np.full(wn, np.nan)
    line[p] = z
    return line


def _sigma(line: np.ndarray) -> float:
    d = second_differences(line)
    return MAD_TO_SIGMA * float(np.median(d)) / SECOND_DIFFERENCE if d.size else 0.0


DIGIT = 16  # bits settled per pass of the median selection


def _median_of_bits(curves: CurveSet, bits: DataFrame) -> DataFrame:
    """Exact median of non-negative doubles given as bit patterns, which order like the numbers.

    Each pass counts one 16-bit digit of the values that share the digits found so far: at
    most 65,536 counts per curve, combined map-side.
    """
    state = bits.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("m")).select(
        "dataset_id", F.explode(F.array(F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2))).alias("k"),
    ).select("dataset_id", F.col("k").alias("rank"), F.col("k").alias("left"), F.lit(0).cast("long").alias("head"))
    state = state.distinct()
    for shift in (48, 32, 16, 0):
        rows = bits.join(F.broadcast(state), "dataset_id") if curves.small_catalog else attach_salted(bits, state, ("dataset_id",), F.col("b"))
        digit = F.shiftright("b", shift).bitwiseAND((1 << DIGIT) - 1)
        held = F.lit(True) if shift == 48 else (F.shiftright("b", shift + DIGIT) == F.col("head"))
        counts = rows.filter(held).groupBy("dataset_id", "rank", "head", "left", digit.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("dataset_id", "rank").orderBy("d")
        counts = counts.withColumn("cum", F.sum("n").over(upto))
        state = counts.filter((F.col("left") < F.col("cum")) & (F.col("left") >= F.col("cum") - F.col("n"))).select(
            "dataset_id", "rank", (F.col("left") - (F.col("cum") - F.col("n"))).alias("left"),
            F.shiftleft("head", DIGIT).bitwiseOR(F.col("d")).alias("head"))

    @pandas_udf("double")
    def decode(b: pd.Series) -> pd.Series:
        return pd.Series(b.to_numpy(dtype=np.int64).view(np.float64))

    return state.select("dataset_id", decode("head").alias("v")).groupBy("dataset_id").agg(F.avg("v").alias("median"))
