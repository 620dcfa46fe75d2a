"""Peak detection by prominence, with widths and signal-to-noise ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from heightfield.functions.expr import floordiv, nan, raw_to_real
from heightfield.model import CurveSet
from heightfield.operators.curve import _line, _sigma, noise
from heightfield.operators.statistics import finite_range
from heightfield.plans.iterate import cut
from heightfield.plans.layout import CHUNK, attach, bound_batches, halo_chunks, with_curve_geometry
from heightfield.plans.lines import floats

FAN = 1024   # chunks whose outlines are looked up together
SHARE = 32   # chunks whose walks meet these outlines in one row
WORK = 1 << 16  # samples a task follows walks over at once; at least one row
PEAK = "array<struct<i:int,value:double,prominence:double,width:double>>"


def local_maxima(line: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima whose neighbours are finite."""
    ok = np.isfinite(line)
    mid = line[1:-1]
    with np.errstate(invalid="ignore"):
        top = (mid > line[:-2]) & (mid > line[2:]) & ok[1:-1] & ok[:-2] & ok[2:]
    return np.flatnonzero(top) + 1


class Heights:
    """Maxima and minima of all runs of 1, 2, 4, ... samples, by which many walks over a line are followed at once."""

    def __init__(self, line: np.ndarray, bottoms: np.ndarray | None = None):
        self.n = len(line)
        self.high = [np.where(np.isnan(line), np.inf, line)]  # a NaN stops every walk
        self.low = [self.high[0] if bottoms is None else bottoms]
        while 2 << (len(self.high) - 1) <= self.n:
            half = 1 << (len(self.high) - 1)
            for table, pick in ((self.high, np.maximum), (self.low, np.minimum)):
                table.append(pick(table[-1][:-half], table[-1][half:]))

    def stops(self, at: np.ndarray, side: int, ceiling: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first sample from each place on, to one side, that is not below its ceiling or not above its floor; -1 or n if none."""
        at = at + side
        for k in range(len(self.high) - 1, -1, -1):
            size = 1 << k
            start = at if side > 0 else at - size + 1
            inside = (start >= 0) & (start + size <= self.n)
            run = np.clip(start, 0, self.n - size)
            free = inside & (self.high[k][run] < ceiling) & ~(self.low[k][run] <= floor)
            at = np.where(free, at + side * size, at)
        return at

    def lowest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least sample of each stretch, ends included; stretches are not empty."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first))
        for level in np.unique(k):
            w = k == level
            out[w] = np.minimum(self.low[level][first[w]], self.low[level][last[w] - (1 << int(level)) + 1])
        return out


def descend(line: np.ndarray, wanted: np.ndarray, side: int, heights: Heights | None = None,
            inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Walk to one side from each wanted index while samples are not higher.

    Returns the lowest finite value met (the start value if none) and whether the walk ran off the end, or into a sample that is not ``inside``.
    """
    if not len(wanted):
        return np.empty(0), np.zeros(0, dtype=bool)
    heights = heights or Heights(line)
    stop = heights.stops(wanted, side, np.nextafter(line[wanted], np.inf), np.full(len(wanted), np.nan))
    if np.isneginf(line).any():
        heights = Heights(np.where(np.isneginf(line), np.inf, line))
    near, far = (stop + 1, wanted) if side < 0 else (wanted, stop - 1)
    off = (stop < 0) | (stop == len(line))
    return heights.lowest(near, far), off if inside is None else off | ~inside[np.clip(stop, 0, len(line) - 1)]


def crossings(line: np.ndarray, at: np.ndarray, side: int, value: np.ndarray, level: np.ndarray, first: int, last: int,
              heights: Heights | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Walk from each place to one side while level < z < value; (stopped, interpolated crossing or NaN) within first..last.

    The drop between the two samples is taken in single precision, as samples are stored, and the
    crossing is measured from the left one of them.
    """
    core = line[first:last + 1]
    j = (heights or Heights(core)).stops(at - first, side, value, level)
    stopped = (j >= 0) & (j < len(core))
    j = np.clip(j, 0, len(core) - 1) + first
    return stopped, np.where(stopped, between(line, j, side, level), np.nan)


def between(line: np.ndarray, j: np.ndarray, side: int, level: np.ndarray, origin=0) -> np.ndarray:
    """Where the level is crossed next to each stopping sample, counted from ``origin``; NaN if the sample does not lie below it."""
    z, inner = line[j], line[np.clip(j - side, 0, len(line) - 1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        drop = (inner.astype(np.float32) - z.astype(np.float32)).astype(np.float64)
        place = (j - origin) + (level - z) / drop if side < 0 else (j - origin) - 1 + (inner - level) / drop
        return np.where(z <= level, place, np.nan)


def peaks_of(line: np.ndarray, fraction: float) -> list[dict]:
    """All peaks of one curve with a prominence of at least ``fraction`` of the finite range."""
    ok = np.isfinite(line)
    if len(line) < 3 or not ok.any():
        return []
    span = float(line[ok].max() - line[ok].min())
    if not span > 0:
        return []
    top, heights = local_maxima(line), Heights(line)
    prominence = line[top] - np.maximum(descend(line, top, -1, heights)[0], descend(line, top, 1, heights)[0])
    kept = prominence >= fraction * span
    top, prominence = top[kept], prominence[kept]
    value = line[top]
    left, right = (crossings(line, top, side, value, value - prominence * 0.5, 0, len(line) - 1, heights)[1] for side in (-1, 1))
    width = np.where(prominence > 0, right - left, np.nan)
    return [{"i": i, "value": v, "prominence": p, "width": w} for i, v, p, w in zip(top.tolist(), value.tolist(), prominence.tolist(), width.tolist())]


def peak_table(curves: CurveSet, prominence: float = 0.1, min_snr: float = 0.0, min_width: float = 0.0,
               chunk: int = CHUNK) -> DataFrame:
    """One row per kept peak: (dataset_id, i, position, value, prominence, width, snr).

    Width is NaN where a side never falls to half prominence and then disqualifies nothing;
    SNR is infinite on a noiseless curve.
    """
    if not 0.0 <= prominence <= 1.0 or min_snr < 0 or min_width < 0:
        raise ValueError("prominence must be 0 to 1; minimum SNR and width must not be negative")
    c = F.col
    if curves.longest <= chunk:
        found = _whole(curves, prominence, chunk)
    else:
        found = attach(curves, _chunked(curves, prominence, chunk), noise(curves, chunk))
    rows = attach(curves, found, curves.scans.select("dataset_id", c("x").alias("ax")))
    snr = F.when(c("sigma") > 0, c("prominence") / F.when(c("sigma") > 0, c("sigma")).otherwise(F.lit(1.0))).otherwise(F.lit(float("inf")))
    rows = rows.select("dataset_id", "i", raw_to_real(c("ax"), c("i")).alias("position"), "value", "prominence",
                       (c("width") * F.abs(c("ax.step"))).alias("width"), snr.alias("snr"))
    return rows.filter((c("snr") >= min_snr) & (F.isnan("width") | (c("width") >= min_width)))


def dominant_peaks(curves: CurveSet, peaks: DataFrame) -> DataFrame:
    """PeakCount and the most prominent peak (first on a tie) per curve; NaN where there is none."""
    c = F.col
    best = F.max(F.struct("prominence", (-c("i")).alias("ni"), "position", "value", "width", "snr"))
    per = peaks.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
    fields = {"DominantPosition": "position", "DominantValue": "value", "DominantProminence": "prominence",
              "DominantWidth": "width", "DominantSnr": "snr"}
    return curves.scans.select("dataset_id").join(per, "dataset_id", "left").select(
        "dataset_id", F.coalesce("n", F.lit(0)).cast("long").alias("PeakCount"),
        *[F.coalesce(c(f"b.{f}"), nan()).alias(name) for name, f in fields.items()])


def _whole(curves: CurveSet, fraction: float, chunk: int) -> DataFrame:
    """Every curve fits a chunk: one packed row each gives its peaks and its noise."""
    @pandas_udf(f"struct<sigma:double,peaks:{PEAK}>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            lines = [_line(*v) for v in zip(*cols)]
            yield pd.DataFrame({"sigma": [_sigma(v) for v in lines], "peaks": pd.Series([peaks_of(v, fraction) for v in lines], dtype=object)})

    packed = halo_chunks(with_curve_geometry(curves), size=chunk).select("dataset_id", run("p", "z", "wn").alias("r"))
    found = packed.select("dataset_id", F.col("r.sigma").alias("sigma"), F.explode("r.peaks").alias("k")).select("dataset_id", "sigma", "k.*")
    return found.withColumn("width", F.coalesce("width", nan()))  # NaN inside a nested result arrives as NULL


# --- curves longer than a chunk -------------------------------------------------------------
#
# A walk that leaves its chunk is continued in two steps: the chunk outlines (highest and lowest
# sample, one row per chunk) tell in which chunk it must stop, and that chunk alone is searched.

WALK = "struct<i:int,side:int,value:double,level:double,low:double>"
OUTLINE = "array<struct<i:int,value:double,left:double,right:double,lopen:boolean,ropen:boolean>>"


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches again, cut to about WORK elements of an array column."""
    for b in batches:
        upto = np.cumsum(np.asarray(b.column(column).value_lengths()))
        first = 0
        while first < len(upto):
            last = max(first + 1, int(np.searchsorted(upto, WORK + (upto[first - 1] if first else 0), "right")))
            yield b.slice(first, last - first)
            first = last


def _ints(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(k).to_numpy().astype(np.int64) for k in names]


class _Windows:
    """The windows of many chunks end to end, a NaN around each, so that walks in all of them are followed at once.

    ``line`` has the windows, ``core`` only their chunks (NaN elsewhere), ``inside`` marks these; ``start`` is where a window begins.
    """

    def __init__(self, b: pa.RecordBatch):
        wn, self.a, self.i0, self.cn, self.n = _ints(b, "wn", "a", "i0", "cn", "n")
        self.start = np.cumsum(wn + 1) - wn
        self.line = np.full(int(wn.sum()) + len(wn) + 1, np.nan)
        p = b.column("p")
        self.line[np.repeat(self.start, np.asarray(p.value_lengths())) + p.flatten().to_numpy()] = floats(b.column("z"))
        self.first = np.cumsum(self.cn) - self.cn  # of each chunk among the samples of all chunks
        self.at = np.repeat(self.start + self.i0 - self.a - self.first, self.cn) + np.arange(int(self.cn.sum()))
        self.inside = np.zeros(len(self.line), bool)
        self.inside[self.at] = True
        self.core = np.where(self.inside, self.line, np.nan)


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Highest and lowest sample of each chunk, and the walks from its maxima with what they met in the chunk."""
    for b in _portions(batches, "z"):
        w = _Windows(b)
        top = local_maxima(w.line)
        top = top[w.inside[top]]
        of = np.searchsorted(w.start, top, "right") - 1
        heights = Heights(w.core)
        (left, lopen), (right, ropen) = (descend(w.core, top, s, heights, w.inside) for s in (-1, 1))
        found = pa.StructArray.from_arrays([
            pa.array((top - w.start[of] + w.a[of]).astype(np.int32)), pa.array(w.line[top]), pa.array(left), pa.array(right),
            pa.array(lopen & (w.i0[of] > 0)), pa.array(ropen & (w.i0[of] + w.cn[of] < w.n[of]))], names=["i", "value", "left", "right", "lopen", "ropen"])
        upto = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))]).astype(np.int32)
        z = w.line[w.at]
        yield pa.RecordBatch.from_arrays([
            b.column("dataset_id"), b.column("c"), pa.array(np.maximum.reduceat(np.where(np.isnan(z), np.inf, z), w.first)),
            pa.array(np.minimum.reduceat(np.where(np.isfinite(z), z, np.inf), w.first)), pa.ListArray.from_arrays(pa.array(upto), found)],
            names=["dataset_id", "c", "top", "bottom", "walks"])


def _asked(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, dict[str, np.ndarray]]:
    """The walks of all rows: the row of each, the walks as they came and their fields."""
    asked = b.column("asked")
    flat = asked.flatten()
    k = flat.field("k")
    values = {f: k.field(f).to_numpy(zero_copy_only=False) for f in ("side", "value", "level", "low")}
    return np.repeat(np.arange(b.num_rows), np.asarray(asked.value_lengths())), k, values | {"at": flat.field("at").to_numpy().astype(np.int64)}


def _chunked(curves: CurveSet, fraction: float, chunk: int) -> DataFrame:
    c = F.col
    packed = cut(halo_chunks(with_curve_geometry(curves), reach=1, size=chunk))
    spans = finite_range(curves.samples).select("dataset_id", (c("hi") - c("lo")).alias("span"))

    key = curves.samples.schema["dataset_id"].dataType.simpleString()
    seen = cut(packed.mapInArrow(_outline, f"dataset_id {key}, c int, top double, bottom double, walks {OUTLINE}"))
    outlines = seen.select("dataset_id", "c", "top", "bottom")
    walks = seen.select("dataset_id", "c", F.explode("walks").alias("k")).select("dataset_id", "c", "k.*")
    opened = walks.select("dataset_id", "c", F.explode(F.array(
        F.when(c("lopen"), _walk(c("i"), -1, c("value"), F.lit(-np.inf), c("left"))),
        F.when(c("ropen"), _walk(c("i"), 1, c("value"), F.lit(-np.inf), c("right"))))).alias("k")).filter("k is not null")
    several = curves.longest > chunk * FAN
    lows = _continue(packed, outlines, opened, chunk, False, several).groupBy("dataset_id", "i").agg(
        F.min(F.when(c("side") == -1, c("low"))).alias("l2"), F.min(F.when(c("side") == 1, c("low"))).alias("r2"))
    proms = walks.join(lows, ["dataset_id", "i"], "left").select(
        "dataset_id", "c", "i", "value",
        (c("value") - F.greatest(F.coalesce("l2", "left"), F.coalesce("r2", "right"))).alias("prominence"))
    kept = cut(attach(curves, proms, spans).filter((c("span") > 0) & (c("prominence") >= fraction * c("span"))).drop("span"))

    level = c("value") - c("prominence") * 0.5
    sides = kept.select("dataset_id", "c", F.explode(F.array(*[
        _walk(c("i"), s, c("value"), level, F.lit(np.inf)) for s in (-1, 1)])).alias("k"))
    near = cut(_search(packed, sides.withColumn("at", c("k.i")), width=True))
    further = near.filter(~c("stopped")).select("dataset_id", "c", "k")
    ends = near.filter("stopped").select("dataset_id", c("k.i").alias("i"), c("k.side").alias("side"), c("low").alias("at"))
    ends = ends.unionByName(_continue(packed, outlines, further, chunk, True, several).select(
        "dataset_id", "i", "side", c("low").alias("at")))
    widths = ends.groupBy("dataset_id", "i").agg(
        (F.max(F.when(c("side") == 1, c("at"))) - F.max(F.when(c("side") == -1, c("at")))).alias("width"))
    return kept.join(widths, ["dataset_id", "i"], "left").select(
        "dataset_id", "i", "value", "prominence",
        F.when(c("prominence") > 0, F.coalesce("width", nan())).otherwise(nan()).alias("width"))


def _walk(i, side, value, level, low):
    return F.struct(i.alias("i"), F.lit(side).alias("side"), value.alias("value"), level.alias("level"), low.alias("low")).cast(WALK)


def _continue(packed: DataFrame, outlines: DataFrame, opened: DataFrame, chunk: int, width: bool, several: bool) -> DataFrame:
    """Finish walks that left their chunk: (dataset_id, i, side, low) with low the minimum or the crossing.

    The stopping chunk is looked up among the FAN chunks around the walk.  For a curve of more
    chunks (``several``) the few walks that leave even those are routed over outlines of FAN
    chunks each, then down again inside the block where they must stop.
    """
    c = F.col
    units = outlines.withColumn("g", floordiv(c("c"), FAN) if several else F.lit(0))
    walks = opened.select("dataset_id", floordiv(c("c"), FAN).alias("g") if several else F.lit(0).alias("g"), c("c").alias("at"), "k")
    routed = cut(_route(units, walks, width))
    found, off = routed.filter("unit is not null"), routed.filter("unit is null")
    if several:
        blocks = units.groupBy("dataset_id", c("g").alias("c")).agg(F.max("top").alias("top"), F.min("bottom").alias("bottom"))
        over = off.select("dataset_id", F.lit(0).alias("g"), c("g").alias("at"), "k")
        high = cut(_route(blocks.withColumn("g", F.lit(0)), over, width))
        off = high.filter("unit is null")
        edge = F.when(c("k.side") == -1, (c("unit") + 1) * FAN).otherwise(c("unit") * FAN - 1)
        down = high.filter("unit is not null").select("dataset_id", c("unit").alias("g"), edge.alias("at"), "k")
        found = found.unionByName(cut(_route(units, down, width)))
    ends = off.select("dataset_id", c("k.i").alias("i"), c("k.side").alias("side"), nan().alias("low") if width else c("k.low").alias("low"))
    inside = found.select("dataset_id", c("unit").alias("c"), "k",
                          F.when(c("k.side") == -1, (c("unit") + 1) * chunk).otherwise(c("unit") * chunk - 1).alias("at"))
    met = _search(packed, inside, width).select("dataset_id", c("k.i").alias("i"), c("k.side").alias("side"), "low")
    return ends.unionByName(met)


def _route(units: DataFrame, walks: DataFrame, width: bool) -> DataFrame:
    """Nearest unit each walk must stop in, among the units of its group (dataset_id, g).

    ``units`` is (dataset_id, g, c, top, bottom), ``walks`` (dataset_id, g, at, k); a walk
    starts next to unit ``at``.  Gives (dataset_id, g, unit, k): unit NULL when the walk runs
    out of the group, with k.low lowered by the units it crossed.
    """
    c = F.col
    outline = units.groupBy("dataset_id", "g").agg(F.sort_array(F.collect_list(F.struct("c", "top", "bottom"))).alias("u"))
    outline = outline.select("dataset_id", "g", c("u.c")[0].alias("first"), c("u.top").alias("top"), c("u.bottom").alias("bottom"))

    block = [c("dataset_id"), c("g"), floordiv(c("at"), SHARE).alias("_s")]
    asked = walks.groupBy(*block).agg(F.collect_list(F.struct("k", "at")).alias("asked")).drop("_s")
    key = dict(walks.dtypes)["dataset_id"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, "top"):
            row, k, v = _asked(b)
            many = np.asarray(b.column("top").value_lengths()).astype(np.int64)
            start = np.cumsum(many + 1) - many  # a wall around the outline of each row
            places = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            tops, bottoms = (np.full(int(many.sum()) + len(many) + 1, np.inf) for _ in range(2))
            tops[places], bottoms[places] = floats(b.column("top")), floats(b.column("bottom"))
            inside = np.zeros(len(tops), bool)
            inside[places] = True
            first = b.column("first").to_numpy().astype(np.int64)
            at = v["at"] - first[row] + start[row]
            heights = Heights(tops, bottoms)
            unit, low = np.full(len(at), -1), v["low"].copy()
            for s in (-1, 1):
                w = np.flatnonzero(v["side"] == s)
                value = v["value"][w]
                stop = heights.stops(at[w], s, value, v["level"][w]) if width else heights.stops(
                    at[w], s, np.nextafter(value, np.inf), np.full(len(w), np.nan))
                unit[w] = np.where(inside[stop], stop - start[row[w]] + first[row[w]], -1)
                begin, end = (stop + 1, at[w] - 1) if s < 0 else (at[w] + 1, stop - 1)
                some = begin <= end
                low[w[some]] = np.minimum(low[w[some]], heights.lowest(begin[some], end[some]))
            fields = [pa.array(low) if f.name == "low" else k.field(f.name) for f in k.type]
            yield pa.RecordBatch.from_arrays([
                b.column("dataset_id").take(pa.array(row)), b.column("g").take(pa.array(row)), pa.array(unit.astype(np.int32), mask=unit < 0),
                pa.StructArray.from_arrays(fields, names=[f.name for f in k.type])], names=["dataset_id", "g", "unit", "k"])

    met = asked.join(outline, ["dataset_id", "g"])
    bound_batches(met)
    return met.mapInArrow(follow, f"dataset_id {key}, g int, unit int, k {WALK}")


def _search(packed: DataFrame, walks: DataFrame, width: bool) -> DataFrame:
    """Search one chunk per walk from sample ``at`` on: adds ``stopped`` and ``low`` to each walk."""
    asked = walks.groupBy("dataset_id", "c").agg(F.collect_list(F.struct("k", "at")).alias("asked"))

    key = dict(walks.dtypes)["dataset_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, "z"):
            row, k, v = _asked(b)
            w = _Windows(b)
            heights = Heights(w.core)
            lows = None if width else Heights(np.where(np.isfinite(w.core), w.core, np.inf))
            at = v["at"] - w.a[row] + w.start[row]
            out, stopped = v["low"].copy(), np.zeros(len(at), bool)
            for s in (-1, 1):
                q = np.flatnonzero(v["side"] == s)
                own, value = row[q], v["value"][q]
                if width:
                    stop = heights.stops(at[q], s, value, v["level"][q])
                    place = between(w.line, stop, s, v["level"][q], w.start[own]) + w.a[own]
                    out[q] = np.where(w.inside[stop], place, np.nan)
                    stopped[q] = w.inside[stop] | (w.i0[own] == 0 if s < 0 else w.i0[own] + w.cn[own] == w.n[own])
                    continue
                stop = heights.stops(at[q], s, np.nextafter(value, np.inf), np.full(len(q), np.nan))
                stopped[q] = w.inside[stop]
                begin, end = (stop + 1, at[q] - 1) if s < 0 else (at[q] + 1, stop - 1)
                some = begin <= end
                out[q[some]] = np.minimum(out[q[some]], lows.lowest(begin[some], end[some]))
            yield pa.RecordBatch.from_arrays([b.column("dataset_id").take(pa.array(row)), b.column("c").take(pa.array(row)), k, pa.array(stopped), pa.array(out)],
                                             names=["dataset_id", "c", "k", "stopped", "low"])

    return packed.join(asked, ["dataset_id", "c"]).mapInArrow(scan, f"dataset_id {key}, c int, k {WALK}, stopped boolean, low double")
