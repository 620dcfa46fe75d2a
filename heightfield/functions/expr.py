"""Column expressions shared by the operators (JVM-side, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def nan() -> Column:
    return F.lit(NAN)


def finite(value: Column) -> Column:
    """True for real numbers; NaN compares greatest in Spark, so one test covers NaN and both infinities."""
    return F.abs(value) < F.lit(INF)


def clamp(value: Column, low, high) -> Column:
    return F.greatest(_lit(low), F.least(_lit(high), value))


def ratio(num: Column, den: Column, otherwise: float = NAN) -> Column:
    """``num / den`` with a fixed result for a zero divisor (ANSI mode would raise)."""
    return F.when(den == 0, F.lit(otherwise)).otherwise(num / F.when(den == 0, F.lit(1.0)).otherwise(den))


def floordiv(value: Column, size) -> Column:
    """Integer block number of a non-negative index."""
    return F.floor(value / _lit(size)).cast("int")


def raw_to_real(ax: Column, index: Column) -> Column:
    """Axis coordinate of a sample index: origin + step * (index, or its mirror on a reversed axis)."""
    step_no = F.when(ax["direction"] == "Reverse", ax["count"] - 1 - index).otherwise(index)
    return ax["origin"] + ax["step"] * step_no


def gram_basis(index: Column, n: Column, order: int) -> list[Column]:
    """Monic discrete orthogonal polynomials on 0..n-1, evaluated at ``index``.

    The abscissa is scaled to [-1, 1].  On a complete uniform grid they are mutually
    orthogonal, so a least-squares fit needs only the sums of p_k * z and the closed-form
    norms: no normal equations, and no conditioning trouble at order 8.
    """
    span = F.greatest(n - 1, F.lit(1)).cast("double")
    t = (F.lit(2.0) * index - (n - 1)) / span
    basis = [F.lit(1.0), t]
    for k in range(1, order):
        basis.append(t * basis[k] - gram_beta(k, n) * basis[k - 1])
    return basis[: order + 1]


def gram_beta(k: int, n: Column) -> Column:
    nd = n.cast("double")
    span = F.greatest(nd - 1, F.lit(1.0))
    return (k * k) * (nd * nd - k * k) / ((4.0 * k * k - 1.0) * span * span)


def gram_norm(n: Column, order: int) -> list[Column]:
    """Sum over the grid of p_k squared, k = 0..order; zero where n <= k."""
    norms = [n.cast("double")]
    for k in range(1, order + 1):
        norms.append(F.when(n <= k, F.lit(0.0)).otherwise(norms[k - 1] * gram_beta(k, n)))
    return norms


def total(terms: list[Column]) -> Column:
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


# Fixed value: ISO 16610-21 Gaussian constant, sqrt(ln 2 / pi).
GAUSS_ALPHA = math.sqrt(math.log(2.0) / math.pi)


def gauss_reach(cutoff, step: Column) -> Column:
    """Samples on each side covered by the Gaussian weighting function (four sigma, at least one), within what an index can hold."""
    return F.least(F.lit(1 << 30), F.greatest(F.lit(1), F.ceil(4.0 * (GAUSS_ALPHA * _lit(cutoff) / step)))).cast("int")


def _lit(value):
    return value if isinstance(value, Column) else F.lit(value)
