"""Asymmetric least-squares baseline of curves of any length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import floordiv
from heightfield.model import CurveSet
from heightfield.plans.iterate import cut
from heightfield.plans.layout import CHUNK, chunk_samples, halo_chunks, with_curve_geometry

SEGMENT = 256  # samples eliminated together inside one chunk
STEP = 64      # piece lengths are padded to a multiple of this
WORK = 1 << 16  # samples a task eliminates together, whatever the rows of a batch; at least one row
FAN = 1024     # chunks, or groups of chunks, whose borders are solved together


def penalty_bands(i0: int, count: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i0..i0+count-1 of D'D for second differences over n samples: diagonal and two sub-diagonals."""
    i = np.arange(i0, i0 + count)
    # a difference row starting at k covers k, k+1, k+2, for k = 0..n-3
    def has(k):
        return ((k >= 0) & (k <= n - 3)).astype(float)

    return (has(i) + 4.0 * has(i - 1) + has(i - 2), -2.0 * has(i - 1) - 2.0 * has(i - 2), has(i - 2))


def banded_solve(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solve many symmetric positive-definite systems of half-bandwidth two, one vector step per row.

    Bands are (m, systems) with d1[i] = A[i, i-1] and d2[i] = A[i, i-2]; rhs is
    (m, systems, k).  A system with a non-positive pivot comes back as NaN.
    """
    m = len(d0)
    piv, l1, l2 = np.ones_like(d0), np.zeros_like(d0), np.zeros_like(d0)
    x = rhs.astype(np.float64, copy=True)
    bad = np.zeros(d0.shape[1], dtype=bool)
    for i in range(m):
        p = d0[i]
        if i >= 2:
            l2[i] = d2[i] / piv[i - 2]
            p = p - l2[i] * d2[i]
            x[i] -= l2[i, :, None] * x[i - 2]
        if i >= 1:
            e = d1[i] - l2[i] * piv[i - 2] * l1[i - 1] if i >= 2 else d1[i]
            l1[i] = e / piv[i - 1]
            p = p - l1[i] * e
            x[i] -= l1[i, :, None] * x[i - 1]
        bad |= ~((p > 0) & np.isfinite(p))
        piv[i] = np.where(bad, 1.0, p)
    x /= piv[:, :, None]
    for i in range(m - 2, -1, -1):
        x[i] -= l1[i + 1, :, None] * x[i + 1]
        if i + 2 < m:
            x[i] -= l2[i + 2, :, None] * x[i + 2]
    x[:, bad] = np.nan
    return x


class Piece:
    """A stretch of the system whose last two unknowns are a separator (none on the final stretch).

    Eliminating the inside leaves each separator coupled only to its neighbours; that is
    what lets stretches be solved apart, inside a task and across tasks alike.
    """

    def __init__(self, y: np.ndarray, w: np.ndarray, i0: int, n: int, lam: float):
        self.count, self.final = len(y), i0 + len(y) == n
        p0, p1, p2 = penalty_bands(i0, self.count, n)
        self.d0, self.d1, self.d2 = w + lam * p0, lam * p1, lam * p2
        self.rhs = w * y
        self.inner = self.count if self.final else self.count - 2
        self.first = i0 == 0

    def columns(self) -> np.ndarray:
        """Right-hand sides of the inside: data, left separator (2), right separator (2)."""
        m = self.inner
        b = np.zeros((m, 5))
        b[:, 0] = self.rhs[:m]
        if not self.first:  # the two samples before this piece are its left separator
            b[0, 1], b[0, 2] = self.d2[0], self.d1[0]
            if m > 1:
                b[1, 2] = self.d2[1]
        if not self.final:
            if m > 1:
                b[m - 2, 3] = self.d2[m]
            b[m - 1, 3], b[m - 1, 4] = self.d1[m], self.d2[m + 1]
        return b

    def separator(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.inner
        a = np.array([[self.d0[m], self.d1[m + 1]], [self.d1[m + 1], self.d0[m + 1]]])
        return a, self.rhs[m:m + 2]


def solve_inside(pieces: list[Piece]) -> list[np.ndarray]:
    """Inside solutions for the five right-hand sides, vectorised over pieces of similar length.

    Shorter pieces are padded with decoupled unit rows; a batch is kept to a few dozen megabytes.
    """
    out: list[np.ndarray] = [np.empty((0, 5))] * len(pieces)
    sizes: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        sizes.setdefault(-(-piece.inner // STEP) * STEP, []).append(k)
    for m, members in sizes.items():
        room = max(1, 1_000_000 // m)
        for start in range(0, len(members), room):
            pick = members[start:start + room]
            bands = [np.zeros((m, len(pick))) for _ in range(3)]
            bands[0][:] = 1.0
            rhs = np.zeros((m, len(pick), 5))
            for j, k in enumerate(pick):
                piece = pieces[k]
                for band, own in zip(bands, (piece.d0, piece.d1, piece.d2)):
                    band[:piece.inner, j] = own[:piece.inner]
                rhs[:piece.inner, j] = piece.columns()
            x = banded_solve(*bands, rhs)
            for j, k in enumerate(pick):
                out[k] = x[:pieces[k].inner, j]
    return out


@dataclass(frozen=True)
class Stretch:
    """A stretch whose inside is eliminated.

    ``g`` (4x4) and ``f`` (4) are what the elimination takes away from the equations of the left
    and right separators; ``a`` (2x2) and ``b`` (2) are the right separator's own equations.
    """

    g: np.ndarray
    f: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def packed(self) -> np.ndarray:
        return np.concatenate([self.g.ravel(), self.f, self.a.ravel(), self.b])

    @staticmethod
    def unpacked(t) -> "Stretch":
        t = np.asarray(t)
        return Stretch(t[:16].reshape(4, 4), t[16:20], t[20:24].reshape(2, 2), t[24:26])


def stretch_of(piece: Piece, inside: np.ndarray) -> Stretch:
    c = piece.columns()
    g = c[:, 1:].T @ inside
    a, b = (np.zeros((2, 2)), np.zeros(2)) if piece.final else piece.separator()
    return Stretch(g[:, 1:], g[:, 0], a, b)


def chain(parts: list[Stretch]) -> np.ndarray:
    """Separators between consecutive stretches for the five right-hand sides: (parts - 1, 2, 5)."""
    k = len(parts) - 1
    rhs = np.zeros((k, 2, 5))
    diag, off = np.zeros((k, 2, 2)), np.zeros((k, 2, 2))
    for j in range(k):
        own, after = parts[j], parts[j + 1]
        diag[j] = own.a - own.g[2:, 2:] - after.g[:2, :2]
        off[j] = -after.g[:2, 2:]
        rhs[j, :, 0] = own.b - own.f[2:] - after.f[:2]
    if k:
        rhs[0, :, 1:3] = -parts[0].g[2:, :2]
        rhs[k - 1, :, 3:5] = -parts[k].g[:2, 2:]
    for j in range(1, k):
        back = np.linalg.solve(diag[j - 1], np.concatenate([off[j - 1], rhs[j - 1]], axis=1))
        diag[j] -= off[j - 1].T @ back[:, :2]
        rhs[j] -= off[j - 1].T @ back[:, 2:]
    for j in range(k - 1, -1, -1):
        rhs[j] = np.linalg.solve(diag[j], rhs[j] - (off[j] @ rhs[j + 1] if j + 1 < k else 0.0))
    return rhs


def condense(parts: list[Stretch]) -> Stretch:
    """Consecutive stretches as one: their inner separators are eliminated too."""
    if len(parts) == 1:
        return parts[0]
    x, first, last = chain(parts), parts[0], parts[-1]
    g, f = np.zeros((4, 4)), np.concatenate([first.f[:2], last.f[2:]])
    g[:2, :2], g[2:, 2:] = first.g[:2, :2], last.g[2:, 2:]
    couple = ((slice(0, 2), -first.g[:2, 2:], x[0]), (slice(2, 4), -last.g[2:, :2], x[-1]))
    for rows, c, near in couple:
        g[rows] += c @ near[:, 1:]
        f[rows] += c @ near[:, 0]
    return Stretch(g, f, last.a, last.b)


def separators(parts: list[Stretch], left=np.zeros(2), right=np.zeros(2)) -> np.ndarray:
    """All separators around consecutive stretches once the outer two are known: (parts + 1, 2)."""
    x = chain(parts)
    inner = x[:, :, 0] - x[:, :, 1:3] @ left - x[:, :, 3:5] @ right
    return np.vstack([left[None], inner, right[None]])


def expand(piece: Piece, inside: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All unknowns of a piece once its neighbouring separators are known."""
    x = inside[:, 0] - inside[:, 1:3] @ left - inside[:, 3:5] @ right
    return x if piece.final else np.concatenate([x, right])


def reweight(y: np.ndarray, x: np.ndarray, ok: np.ndarray, p: float) -> np.ndarray:
    return np.where(ok, np.where(y > x, p, 1.0 - p), 0.0)


def split(y: np.ndarray, w: np.ndarray, lam: float, i0: int = 0, n: int | None = None) -> list[Piece]:
    """Pieces of the samples i0, i0 + 1, ... of a curve of n samples."""
    n = len(y) if n is None else n
    bounds = list(range(0, len(y), SEGMENT))
    if len(bounds) > 1 and len(y) - bounds[-1] < 4:
        bounds.pop()  # a piece needs an inside next to its separator
    return [Piece(y[s:e], w[s:e], i0 + s, n, lam) for s, e in zip(bounds, [*bounds[1:], len(y)])]


def reduce_all(parts: list[list[Piece]]) -> list[tuple[list[Piece], list[np.ndarray], list[Stretch] | None]]:
    """Eliminate the insides of many lists of pieces in one vectorised pass; None where singular."""
    inside = iter(solve_inside([piece for part in parts for piece in part]))
    out = []
    for part in parts:
        own = [next(inside) for _ in part]
        ok = not any(np.isnan(x).any() for x in own)
        out.append((part, own, [stretch_of(*v) for v in zip(part, own)] if ok else None))
    return out


def whittaker(curves: list[tuple[np.ndarray, np.ndarray]], lam: float) -> list[np.ndarray]:
    """Per (y, w): minimise sum w (y - x)^2 + lam * sum (second difference of x)^2; NaN when singular."""
    out = []
    for part, own, stretches in reduce_all([split(y, w, lam) for y, w in curves]):
        if stretches is None:
            out.append(np.full(sum(piece.count for piece in part), np.nan))
            continue
        out.append(unfold(part, own, separators(stretches)))
    return out


def unfold(part: list[Piece], own: list[np.ndarray], s: np.ndarray) -> np.ndarray:
    return np.concatenate([expand(piece, x, s[k], s[k + 1]) for k, (piece, x) in enumerate(zip(part, own))])


def portions(*cols: pd.Series) -> Iterator[list[pd.Series]]:
    """The rows of a batch, about WORK samples at a time; the first column holds the samples."""
    upto = np.cumsum([len(z) for z in cols[0]])
    first = 0
    while first < len(upto):
        last = max(first + 1, int(np.searchsorted(upto, WORK + (upto[first - 1] if first else 0), "right")))
        yield [v.iloc[first:last] for v in cols]
        first = last


def asls(lines: list[np.ndarray], lam: float, p: float, iterations: int) -> list[np.ndarray | None]:
    """Baselines of several curves; None where fewer than three samples are finite or the system is singular."""
    oks = [np.isfinite(z) for z in lines]
    ys = [np.where(ok, z, 0.0) for z, ok in zip(lines, oks)]
    ws = [ok.astype(float) for ok in oks]
    fit = [k for k, ok in enumerate(oks) if ok.sum() >= 3]
    out: list[np.ndarray | None] = [None] * len(lines)
    for _ in range(iterations):
        for k, x in zip(fit, whittaker([(ys[k], ws[k]) for k in fit], lam)):
            out[k] = x
            ws[k] = reweight(ys[k], x, oks[k], p)
        for k in fit:
            if out[k] is not None and np.isnan(out[k]).any():
                out[k] = None
        fit = [k for k in fit if out[k] is not None]
    return out


def baseline(curves: CurveSet, lam: float = 1e5, p: float = 0.01, iterations: int = 10, chunk: int = CHUNK) -> CurveSet:
    """Curves minus their asymmetric least-squares baseline; unchanged where it cannot be fitted."""
    if not 1.0 <= lam < float("inf") or not 1e-4 <= p <= 0.5 or not 1 <= iterations <= 100:
        raise ValueError("lam must be at least 1, p 1e-4 to 0.5, iterations 1 to 100")
    if curves.longest > chunk:
        return _chunked(curves, lam, p, iterations, chunk)

    @pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            out = []
            for part in portions(*cols):
                lines = []
                for pos, z, wn in zip(*part):
                    line = np.full(wn, np.nan, dtype=np.float32)
                    line[pos] = z
                    lines.append(line)
                bases = asls([line.astype(np.float64) for line in lines], lam, p, iterations)
                out += [line if x is None else (line.astype(np.float64) - x).astype(np.float32) for line, x in zip(lines, bases)]
            yield pd.Series(out, dtype=object)

    packed = halo_chunks(with_curve_geometry(curves), size=chunk)
    return curves.with_samples(chunk_samples(packed.withColumn("out", run("p", "z", "wn")), "out"))


def _chunked(curves: CurveSet, lam: float, p: float, iterations: int, chunk: int) -> CurveSet:
    """The same solve with each chunk of a long curve in its own task.

    A round eliminates the inside of every chunk, solves for the chunk borders (two unknowns per
    chunk, again condensed in groups of FAN chunks, so no task sees more than FAN borders of a
    level), and feeds the border values back.  The packed chunks and their weights are the
    only state, checkpointed once per round.
    """
    if chunk < 8:
        raise ValueError("chunks must hold at least eight samples")
    c = F.col
    packed = halo_chunks(with_curve_geometry(curves), size=chunk)

    @pandas_udf("struct<z:array<float>,w:array<double>,ok:bigint>")
    def begin(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            lines = []
            for pos, z, wn in zip(*cols):
                line = np.full(wn, np.nan, dtype=np.float32)
                line[pos] = z
                lines.append(line)
            yield pd.DataFrame({"z": pd.Series(lines, dtype=object),
                                "w": pd.Series([np.isfinite(v).astype(float) for v in lines], dtype=object),
                                "ok": pd.Series([int(np.isfinite(v).sum()) for v in lines], dtype="int64")})

    def pieces(z, w, i0, n):
        y = samples(z)
        return split(np.where(np.isfinite(y), y, 0.0), np.asarray(w), lam, int(i0), int(n))

    def samples(z):
        return np.asarray(z, dtype=np.float64)  # a NULL element is a NaN that passed through Arrow

    @pandas_udf("array<double>")
    def eliminate(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            out = []
            for part in portions(*cols):
                out += [None if s is None else condense(s).packed() for _, _, s in reduce_all([pieces(*v) for v in zip(*part)])]
            yield pd.Series(out, dtype=object)

    @pandas_udf("struct<w:array<double>,x:array<double>>")
    def advance(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            ws, xs = [], []
            for rows in portions(*cols):
                done = reduce_all([pieces(*v) for v in zip(*rows[:4])])
                for z, s, (part, own, stretches) in zip(rows[0], rows[4], done):
                    s, y = np.asarray(s), samples(z)
                    x = unfold(part, own, separators(stretches, s[:2], s[2:]))
                    ws.append(reweight(y, x, np.isfinite(y), p))
                    xs.append(x)
            yield pd.DataFrame({"w": pd.Series(ws, dtype=object), "x": pd.Series(xs, dtype=object)})

    state = cut(packed.select("dataset_id", "c", "i0", "n", begin("p", "z", "wn").alias("b")).select(
        "dataset_id", "c", "i0", "n", c("b.z").alias("z"), c("b.w").alias("w"), c("b.ok").alias("ok")))
    enough = state.groupBy("dataset_id").agg(F.sum("ok").alias("ok")).filter("ok >= 3").select("dataset_id")
    live = state.drop("ok").join(enough, "dataset_id", "left_semi").withColumn("x", F.lit(None).cast("array<double>"))
    levels = 0
    while curves.longest > chunk * FAN ** (levels + 1):
        levels += 1
    for _ in range(iterations):
        terms = cut(live.select("dataset_id", "c", eliminate("z", "w", "i0", "n").alias("t")))
        # a curve with a singular chunk drops out and stays unchanged
        singular = terms.filter("t is null").select("dataset_id")
        borders = solve_borders(terms.join(singular, "dataset_id", "left_anti"), levels)
        live = cut(live.join(borders, ["dataset_id", "c"])
                   .select("dataset_id", "c", "i0", "n", "z", advance("z", "w", "i0", "n", "s").alias("b"))
                   .select("dataset_id", "c", "i0", "n", "z", c("b.w").alias("w"), c("b.x").alias("x")))
    done = state.select("dataset_id", "c", "i0", "z").join(live.select("dataset_id", "c", "x"), ["dataset_id", "c"], "left")
    values = done.select("dataset_id", "i0", F.when(c("x").isNull(), c("z")).otherwise(
        F.zip_with("z", "x", lambda z, x: (z.cast("double") - x).cast("float"))).alias("out"))
    return curves.with_samples(chunk_samples(values, "out"))


def solve_borders(terms: DataFrame, levels: int) -> DataFrame:
    """Outer separators of every unit: (dataset_id, c, t) -> (dataset_id, c, s ARRAY<4>).

    With ``levels`` left, groups of FAN units are condensed into one and solved a level up first.
    """
    @pandas_udf("array<double>")
    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for groups in batches:
            yield pd.Series([condense([Stretch.unpacked(t) for t in g]).packed() for g in groups], dtype=object)

    @pandas_udf("array<array<double>>")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for groups, outer in batches:
            out = []
            for g, o in zip(groups, outer):
                o = np.asarray(o)
                s = separators([Stretch.unpacked(t) for t in g], o[:2], o[2:])
                out.append([np.concatenate([s[k], s[k + 1]]) for k in range(len(g))])
            yield pd.Series(out, dtype=object)

    group = floordiv(F.col("c"), FAN) if levels else F.lit(0)
    units = terms.groupBy("dataset_id", group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("u"))
    if levels:
        units = cut(units)
        above = solve_borders(units.select("dataset_id", F.col("g").alias("c"), merge("u.t").alias("t")), levels - 1)
        units = units.join(above.select("dataset_id", F.col("c").alias("g"), F.col("s").alias("o")), ["dataset_id", "g"])
    else:
        units = units.withColumn("o", F.array(*[F.lit(0.0)] * 4))
    solved = units.select("dataset_id", F.arrays_zip(F.col("u.c").alias("c"), solve("u.t", "o").alias("s")).alias("v"))
    return solved.select("dataset_id", F.explode("v").alias("v")).select("dataset_id", "v.c", "v.s")


def baseline_warnings(curves: CurveSet, fitted: CurveSet | None = None) -> DataFrame:
    """(dataset_id, code): non-finite samples excluded, too few finite samples to fit, or a singular fit.

    ``fitted`` is the result: a curve that it hands back unchanged, with enough samples and not zero throughout, had no solution.
    """
    good = F.count(F.when(F.abs("z") < float("inf"), 1))
    seen = curves.geometry().join(curves.samples.groupBy("dataset_id").agg(good.alias("ok")), "dataset_id", "left")
    ok = F.coalesce("ok", F.lit(0))
    codes = F.array_compact(F.array(F.when(ok < F.col("n"), F.lit("profile-baseline.non-finite")),
                                    F.when(ok < 3, F.lit("profile-baseline.low-rank"))))
    told = seen.select("dataset_id", F.explode(codes).alias("code"))
    if fitted is None:
        return told
    z, after = F.when(F.abs("z") < float("inf"), F.col("z")), F.col("after")
    both = curves.samples.join(fitted.samples.select("dataset_id", "i", F.col("z").alias("after")), ["dataset_id", "i"])
    same = both.groupBy("dataset_id").agg(F.count(z).alias("ok"), F.max(F.abs(z)).alias("top"), F.max((z != after).cast("int")).alias("moved"))
    unsolved = same.filter((F.col("ok") >= 3) & (F.col("top") > 0) & (F.col("moved") == 0))
    return told.unionByName(unsolved.select("dataset_id", F.lit("profile-baseline.singular").alias("code")))
