"""Polynomial levelling of images and curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import finite, gram_basis, gram_norm, nan, total
from heightfield.model import CurveSet, ImageSet
from heightfield.operators.statistics import column_mean
from heightfield.plans.layout import attach, with_curve_geometry, with_geometry
from heightfield.plans.lines import attach_lines, mapped, unpacked

SCOPES = ("Line", "Whole", "Surface")
ORIENTATIONS = ("FastAxis", "SlowAxis")
BASEMENTS = ("RegressionToZero", "PreserveOriginalMidpoint")


def _check(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {name} {value!r}")


def _order_ok(order: int) -> None:
    if not 0 <= order <= 8:
        raise ValueError("the order must be 0 to 8")


def flatten(images: ImageSet, scope: str = "Line", order: int = 1, orientation: str = "FastAxis",
            basement: str = "RegressionToZero") -> ImageSet:
    """Subtract a fitted line per scan line, one mean line, or a surface.

    The fit uses discrete orthogonal polynomials: each coefficient is one sum over the
    pixels divided by a closed-form norm, so fitting is a hash aggregate with map-side combine
    and no image is ever gathered.  A line (Line) or image (Whole, Surface) with a
    non-finite pixel becomes NaN; too few points for the order leave it unchanged.
    """
    _check("scope", scope, SCOPES)
    _check("orientation", orientation, ORIENTATIONS)
    _check("basement", basement, BASEMENTS)
    _order_ok(order)
    if scope == "Line" and orientation == "FastAxis" and images.lines is not None:
        return _along_lines(images, order, basement)
    along, n, across = ("x", "w", "y") if orientation == "FastAxis" else ("y", "h", "x")
    base = with_geometry(images)
    if scope == "Surface":
        fitted = _surface(images, base, order)
    elif scope == "Line":
        fitted = _per_line(base, order, along, n, across)
    else:
        fitted = _whole(images, order, along, n)
    flat = fitted.select("dataset_id", "y", "x", "z", F.when(
        F.col("base").isNull(), F.col("z")).when(finite(F.col("base")), F.col("z") - F.col("base").cast("float")).otherwise(nan().cast("float")).alias("flat"))
    if basement == "PreserveOriginalMidpoint":
        flat = _restore_midpoint(images, flat)
    return images.with_pixels(flat.select("dataset_id", "y", "x", F.col("flat").alias("z")))


def _along_lines(images: ImageSet, order: int, basement: str) -> ImageSet:
    """The fit per scan line on packed lines: no exchange of samples."""
    def level(block: np.ndarray, _: dict) -> np.ndarray:
        n = block.shape[1]
        if n <= order:
            return block
        t = (2.0 * np.arange(n) - (n - 1)) / max(n - 1, 1)
        basis = [np.ones(n), t]
        for k in range(1, order):
            basis.append(t * basis[k] - k * k * (n * n - k * k) / ((4.0 * k * k - 1.0) * (n - 1) ** 2) * basis[k - 1])
        p = np.stack(basis[:order + 1], axis=1)
        with np.errstate(invalid="ignore"):
            fit = (block.astype(np.float64) @ p / (p * p).sum(axis=0)) @ p.T
            fit[~np.isfinite(block).all(axis=1)] = np.nan
            return block - fit.astype(np.float32)

    given = attach_lines(images, images.lines, images.geometry()).select("dataset_id", "y", "z")
    flat = mapped(given, level)
    if basement == "PreserveOriginalMidpoint":
        was, now = (unpacked(t).groupBy("dataset_id").agg(_middle("z").alias(name)) for t, name in ((given, "was"), (flat, "now")))
        shift = was.join(now, "dataset_id").select("dataset_id", (F.col("was") - F.col("now")).cast("float").alias("shift"))
        flat = attach_lines(images, flat, shift).select("dataset_id", "y", F.transform("z", lambda v: v + F.col("shift")).alias("z"))
    return images.with_pixels(unpacked(flat), lines=flat)


def _middle(value: str) -> Column:
    return (F.max(F.col(value).cast("double")) + F.min(F.col(value).cast("double"))) / 2


def _coefficients(basis: list[Column], norms: list[Column], value: Column) -> list[Column]:
    return [(F.sum(p * value) / F.first(g)).alias(f"a{k}") for k, (p, g) in enumerate(zip(basis, norms))]


def _evaluate(basis: list[Column]) -> Column:
    return total([F.col(f"a{k}") * p for k, p in enumerate(basis)])


def _per_line(base: DataFrame, order: int, along: str, n: str, across: str) -> DataFrame:
    """One fit per scan line; both sides meet on (dataset_id, line), which spreads any one image."""
    length = F.col(n)
    basis = gram_basis(F.col(along), length, order)
    norms = [F.when(g > 0, g) for g in gram_norm(length, order)]
    fits = (base.filter(length > order).groupBy("dataset_id", across)
            .agg(*_coefficients(basis, norms, F.col("z").cast("double"))))
    return base.join(fits, ["dataset_id", across], "left").withColumn("base", _evaluate(basis))


def _whole(images: ImageSet, order: int, along: str, n: str) -> DataFrame:
    length = F.col(n)
    basis = gram_basis(F.col("i"), length, order)
    norms = [F.when(g > 0, g) for g in gram_norm(length, order)]
    means = column_mean(images, along).join(images.geometry(), "dataset_id").filter(length > order)
    fits = means.groupBy("dataset_id").agg(*_coefficients(basis, norms, F.col("mean")))
    rows = attach(images, images.pixels, images.geometry().join(fits, "dataset_id", "left"))
    return rows.withColumn("base", _evaluate(gram_basis(F.col(along), length, order)))


def _surface(images: ImageSet, base: DataFrame, order: int) -> DataFrame:
    """Products p_a(x) q_b(y), a + b <= order: orthogonal on the full grid, same span as the monomials."""
    w, h = F.col("w"), F.col("h")
    px, qy = gram_basis(F.col("x"), w, order), gram_basis(F.col("y"), h, order)
    gx, gy = gram_norm(w, order), gram_norm(h, order)
    pairs = [(a, b) for a in range(order + 1) for b in range(order + 1 - a)]
    terms = [px[a] * qy[b] for a, b in pairs]
    norms = [F.when(gx[a] * gy[b] > 0, gx[a] * gy[b]) for a, b in pairs]
    fits = (base.filter((w > order) & (h > order)).groupBy("dataset_id")
            .agg(*_coefficients(terms, norms, F.col("z").cast("double"))))
    rows = attach(images, images.pixels, images.geometry().join(fits, "dataset_id", "left"))
    return rows.withColumn("base", _evaluate(terms))


def _restore_midpoint(images: ImageSet, flat: DataFrame) -> DataFrame:
    mids = flat.groupBy("dataset_id").agg(*[_middle(v).alias(f"mid_{v}") for v in ("z", "flat")])
    shift = mids.select("dataset_id", (F.col("mid_z") - F.col("mid_flat")).cast("float").alias("shift"))
    return attach(images, flat, shift).withColumn("flat", F.col("flat") + F.col("shift"))


def flatten_warnings(images: ImageSet, scope: str = "Line", order: int = 1, orientation: str = "FastAxis") -> DataFrame:
    """(dataset_id, code) of images left unchanged because the fit is underdetermined."""
    g = images.geometry()
    if scope == "Surface":
        short = F.col("w").cast("long") * F.col("h") < (order + 1) * (order + 2) // 2
    else:
        short = F.col("w" if orientation == "FastAxis" else "h") <= order
    return g.filter(short).select("dataset_id", F.lit("flatten.underdetermined").alias("code"))


def legendre(t: Column, order: int) -> list[Column]:
    p = [F.lit(1.0), t]
    for k in range(1, order):
        p.append(((2 * k + 1) * t * p[k] - k * p[k - 1]) / (k + 1))
    return p[: order + 1]


def curve_fit(curves: CurveSet, order: int) -> DataFrame:
    """Least-squares coefficients per curve over its finite samples, Legendre basis on [-1, 1].

    (dataset_id, n_finite, coef ARRAY<DOUBLE>); coef is NULL for too few samples or a singular
    system.  The samples only meet in a hash aggregate of moment sums; the solver sees one
    small matrix per curve.
    """
    _order_ok(order)
    t = _scaled(F.col("i"), F.col("n"))
    p = legendre(t, order)
    v = F.col("z").cast("double")
    sums = with_curve_geometry(curves).filter(finite(F.col("z"))).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_finite"),
        F.array(*[F.sum(p[a] * p[b]) for a in range(order + 1) for b in range(a + 1)]).alias("gram"),
        F.array(*[F.sum(p[a] * v) for a in range(order + 1)]).alias("rhs"))

    @pandas_udf("array<double>")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tri = np.tril_indices(order + 1)
        for n_finite, gram, rhs in batches:
            out = []
            for count, g, r in zip(n_finite, gram, rhs):
                a = np.zeros((order + 1, order + 1))
                a[tri] = g
                a = a + a.T - np.diag(np.diag(a))
                usable = count > order and np.isfinite(a).all() and np.linalg.matrix_rank(a) == order + 1
                out.append(np.linalg.solve(a, r) if usable else None)
            yield pd.Series(out, dtype=object)

    return sums.select("dataset_id", "n_finite", solve("n_finite", "gram", "rhs").alias("coef"))


def _scaled(index: Column, n: Column) -> Column:
    return (F.lit(2.0) * index - (n - 1)) / F.greatest(n - 1, F.lit(1)).cast("double")


def flatten_curves(curves: CurveSet, order: int = 1) -> CurveSet:
    """Subtract a polynomial fitted to the finite samples of each curve (in double, then rounded)."""
    fits = curves.geometry().join(curve_fit(curves, order), "dataset_id", "left").select("dataset_id", "n", "coef")
    rows = attach(curves, curves.samples, fits)
    p = legendre(_scaled(F.col("i"), F.col("n")), order)
    base = total([F.col("coef")[k] * p[k] for k in range(order + 1)])
    z = F.when(F.col("coef").isNull(), F.col("z")).otherwise((F.col("z").cast("double") - base).cast("float"))
    return curves.with_samples(rows.select("dataset_id", "i", z.alias("z")))


def flatten_curve_warnings(curves: CurveSet, order: int = 1) -> DataFrame:
    """(dataset_id, code) diagnostics of :func:`flatten_curves`."""
    seen = curves.geometry().join(curve_fit(curves, order), "dataset_id", "left")
    n_finite = F.coalesce("n_finite", F.lit(0))
    code = F.array_compact(F.array(
        F.when(n_finite < F.col("n"), F.lit("profile-flatten.non-finite")),
        F.when(n_finite <= order, F.lit("profile-flatten.low-rank"))
        .when(F.col("coef").isNull(), F.lit("profile-flatten.singular"))))
    return seen.select("dataset_id", F.explode(code).alias("code"))
