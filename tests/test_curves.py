import math

import numpy as np
import pytest
from helpers import curves, lines

from heightfield.operators import baseline, curve, flatten, gauss, peaks, pixel

NAN = math.nan


def wave(seed, n, gaps=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n).cumsum().astype(np.float32)
    if gaps:
        a[rng.choice(n, gaps, replace=False)] = NAN
    return a


def dense_asls(y, lam, p, iterations):
    ok = np.isfinite(y)
    d = np.diff(np.eye(len(y)), 2, axis=0)
    w = ok.astype(float)
    z = np.where(ok, y, 0.0)
    for _ in range(iterations):
        x = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * z)
        w = np.where(ok, np.where(z > x, p, 1 - p), 0.0)
    return y - x


@pytest.mark.parametrize("chunk", [8, 9, 65536])
def test_baseline_equals_dense_solve_in_one_or_many_pieces(spark, chunk, monkeypatch):
    monkeypatch.setattr(baseline, "SEGMENT", 4)
    monkeypatch.setattr(baseline, "FAN", 2)
    arrays = [wave(1, 50), wave(2, 33, gaps=9), wave(3, 17), np.array([1.0, NAN, 2.0, NAN]), wave(4, 3)]
    got = lines(baseline.baseline(curves(spark, *arrays), 50.0, 0.05, 5, chunk=chunk))
    for k, a in enumerate(arrays):
        y = np.asarray(a, dtype=np.float32).astype(float)
        want = dense_asls(y, 50.0, 0.05, 5) if np.isfinite(y).sum() >= 3 else y
        np.testing.assert_allclose(got[k], want, atol=1e-4, err_msg=str(k))


def test_baseline_default_stiffness(spark):
    a = wave(5, 200)
    got = lines(baseline.baseline(curves(spark, a)))[0]
    np.testing.assert_allclose(got, dense_asls(a.astype(float), 1e5, 0.01, 10), atol=1e-3)
    assert [r["code"] for r in baseline.baseline_warnings(curves(spark, [1.0, NAN])).orderBy("code").collect()] == [
        "profile-baseline.low-rank", "profile-baseline.non-finite"]


def brute_peaks(z, fraction):
    out, n = [], len(z)
    ok = np.isfinite(z)
    if not ok.any() or not z[ok].max() > z[ok].min():
        return out
    span = float(z[ok].max()) - float(z[ok].min())
    for i in range(1, n - 1):
        v = float(z[i])
        if not (ok[i - 1] and ok[i] and ok[i + 1] and v > z[i - 1] and v > z[i + 1]):
            continue
        lows = []
        for step in (-1, 1):
            j, low = i + step, v
            while 0 <= j < n and z[j] <= v:
                low = min(low, z[j]) if ok[j] else low
                j += step
            lows.append(float(low))
        prom = v - max(lows)
        if prom < fraction * span:
            continue
        level, ends = v - prom / 2, []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < n and level < z[j] < v:
                j += step
            crossed = 0 <= j < n and z[j] <= level
            ends.append(j - step * (level - float(z[j])) / float(z[j - step] - z[j]) if crossed else NAN)
        out.append((i, v, prom, ends[1] - ends[0] if prom > 0 else NAN))
    return out


@pytest.mark.parametrize("chunk", [3, 8, 65536])
@pytest.mark.parametrize("fraction", [0.0, 0.25])
def test_peaks_equal_brute_force_in_one_or_many_chunks(spark, chunk, fraction, monkeypatch):
    monkeypatch.setattr(peaks, "FAN", 3)
    rng = np.random.default_rng(9)
    ties = rng.integers(0, 4, 60).astype(np.float32)
    spikes = wave(8, 41, gaps=4)
    spikes[10], spikes[30] = math.inf, -math.inf
    arrays = [wave(6, 57), wave(7, 40, gaps=6), ties, np.zeros(5), spikes, np.linspace(0, 9, 30) + np.tile([0, 0.5], 15)]
    got = peaks.peak_table(curves(spark, *arrays, dx=1.0), fraction, chunk=chunk).toPandas()
    for k, a in enumerate(arrays):
        want = brute_peaks(np.asarray(a, dtype=np.float32), fraction)
        own = got[got["dataset_id"] == k].sort_values("i")
        assert own["i"].tolist() == [w[0] for w in want], k
        if want:
            np.testing.assert_allclose(own[["value", "prominence", "width"]].to_numpy(), [w[1:] for w in want], rtol=1e-6)


def test_dominant_peak_first_on_a_tie_and_none(spark):
    c = curves(spark, [0, 2, 0, 2, 0], [0, 0, 0], dx=0.5)
    rows = {r["dataset_id"]: r for r in peaks.dominant_peaks(c, peaks.peak_table(c, 0.1)).collect()}
    assert rows[0]["PeakCount"] == 2 and rows[0]["DominantPosition"] == 0.5 and rows[0]["DominantWidth"] == 0.5
    assert rows[1]["PeakCount"] == 0 and math.isnan(rows[1]["DominantSnr"])


@pytest.mark.parametrize("chunk", [4, 65536])
def test_noise_median_is_exact(spark, chunk):
    arrays = [wave(1, 40), wave(2, 31, gaps=5), [1.0, 2.0], np.full(6, 3.0), np.array([NAN] * 4), 1e-30 * wave(3, 20)]
    got = {r["dataset_id"]: r["sigma"] for r in curve.noise(curves(spark, *arrays), chunk).collect()}
    for k, a in enumerate(arrays):
        a = np.asarray(a, dtype=np.float32).astype(float)
        d = np.abs(2 * a[1:-1] - a[:-2] - a[2:])
        d = d[np.isfinite(d)]
        assert got[k] == pytest.approx(1.482602 * np.median(d) / math.sqrt(6) if d.size else 0.0, rel=1e-9)


@pytest.mark.parametrize("chunk", [6, 65536])
@pytest.mark.parametrize("window,order", [(5, 2), (7, 0), (9, 5)])
def test_smoothing_equals_local_fits(spark, chunk, window, order):
    arrays = [wave(1, 30), wave(2, 25, gaps=7), wave(3, 8)]
    got = lines(curve.smooth(curves(spark, *arrays), window, order, chunk=chunk))
    for k, a in enumerate(arrays):
        n, w = len(a), min(window, len(a))
        want = []
        for i in range(n):
            s = min(max(i - window // 2, 0), n - w)
            x, y = np.arange(s, s + w) - i, a[s:s + w].astype(float)
            ok = np.isfinite(y)
            want.append(np.polynomial.polynomial.polyfit(x[ok], y[ok], order)[0] if ok.sum() > order else a[i])
        np.testing.assert_allclose(got[k], want, rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("chunk", [5, 65536])
def test_gaussian_filter_splits_bands_and_halves_at_cutoff(spark, chunk):
    a = wave(4, 60)
    c = curves(spark, a)
    low, high = (lines(gauss.gaussian_filter(c, b, 0.8, chunk=chunk))[0] for b in ("Waviness", "Roughness"))
    np.testing.assert_allclose(low + high, a, atol=1e-5)
    x = np.arange(400) * 0.1
    tone = np.sin(2 * np.pi * x / 4.0)
    kept = lines(gauss.gaussian_filter(curves(spark, tone), "Waviness", 4.0, chunk=max(chunk, 32)))[0]
    assert kept[100:300].max() == pytest.approx(0.5, abs=0.01)


def test_gaussian_nan_spreads_only_within_reach(spark):
    a = wave(5, 90)
    a[45] = NAN
    out = lines(gauss.gaussian_filter(curves(spark, a), "Waviness", 0.4, chunk=16))[0]
    reach = math.ceil(4 * gauss.GAUSS_ALPHA * 4)
    np.testing.assert_array_equal(np.flatnonzero(np.isnan(out)), np.arange(45 - reach, 46 + reach))


def test_flatten_curve_keeps_gaps_and_short_curves(spark):
    x = np.arange(12.0)
    a = 3 + 2 * x - x * x
    a[4] = NAN
    c = curves(spark, a, [1.0, NAN, NAN], np.full(4, NAN))
    got = lines(flatten.flatten_curves(c, 2))
    assert math.isnan(got[0][4]) and np.nanmax(np.abs(got[0])) < 1e-4
    assert got[1][0] == 1.0
    codes = {(r["dataset_id"], r["code"]) for r in flatten.flatten_curve_warnings(c, 2).collect()}
    assert codes == {(0, "profile-flatten.non-finite"), (1, "profile-flatten.non-finite"), (1, "profile-flatten.low-rank"),
                     (2, "profile-flatten.non-finite"), (2, "profile-flatten.low-rank")}


def test_range_statistics_known_triangle(spark):
    tri = [0, 1, 2, 3, 4, 3, 2, 1, 0]
    rows = {r["dataset_id"]: r for r in curve.range_statistics(curves(spark, tri, [NAN] * 9, [1, 1, NAN, 1, 5, 1, 1, 1, 1], dx=0.5, origin=10.0), 0, 99).collect()}
    t = rows[0]
    assert (t["PeakPosition"], t["Area"], t["Centroid"], t["Fwhm"]) == pytest.approx((12.0, 8.0, 12.0, 2.0))
    assert math.isnan(rows[1]["RangeMin"]) and math.isnan(rows[2]["Area"]) and rows[2]["Fwhm"] == pytest.approx(0.5)
    assert curve.range_statistics(curves(spark, tri), 9, 3).count() == 0


def test_crop_curve_clamps_and_moves_origin(spark):
    out = pixel.crop_curve(curves(spark, [0, 1, 2, 3, 4, 5]), 4, 10)
    np.testing.assert_array_equal(lines(out)[0], [4, 5])
    x = out.scans.first()["x"]
    assert x["count"] == 2 and x["origin"] == pytest.approx(0.4)


def test_smoothing_next_to_gaps_is_the_local_fit(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(size=90)
    z[[3, 20, 21, 50]] = np.nan
    got = lines(curve.smooth(curves(spark, z), 9, 3, chunk=16))[0]
    z = z.astype(np.float32).astype(np.float64)
    for i in range(len(z)):
        first = min(max(i - 4, 0), len(z) - 9)
        x = np.arange(first, first + 9)
        ok = np.isfinite(z[x])
        assert got[i] == pytest.approx(np.polyval(np.polyfit(x[ok] - i, z[x][ok], 3), 0), abs=1e-5)


def test_smoothing_weights_of_a_wide_window():
    for width, order, at in ((5, 2, 2), (5, 2, 0), (501, 8, 3), (2001, 4, 1000)):
        w = curve.savgol_weights(width, order, at)
        x = (np.arange(width) - at) / width
        assert w.sum() == pytest.approx(1.0, abs=1e-12) and all(abs((w * x**k).sum()) < 1e-11 for k in range(1, order + 1))


def test_long_kernels_do_not_depend_on_gaps_elsewhere():
    row = np.random.default_rng(2).normal(size=(1, 3 * 2600)).astype(np.float32)
    weights, norm = gauss.gaussian_weights(1200.0, 2500)
    whole = gauss.smooth_rows(row, weights, norm)
    row[0, -1] = np.nan
    part = gauss.smooth_rows(row, weights, norm)
    assert np.array_equal(whole[0, :-1], part[0, :-1]) and np.isnan(part[0, -1])


def reflected_mean(a, cutoff, dx):
    """Mean line by a kernel summed sample by sample over the reflected curve."""
    sigma = gauss.GAUSS_ALPHA * cutoff / dx
    reach = math.ceil(4 * sigma)
    k = np.arange(-reach, reach + 1)
    w = np.exp(-np.pi * k * k / sigma**2)
    at = gauss.mirror(np.arange(len(a))[:, None] + k[None, :], len(a))
    return (w * a.astype(np.float64)[at]).sum(1) / w.sum()


@pytest.mark.parametrize("cutoff", [0.2, 1.3, 2.9, 6.0, 21.0, 1e4])
def test_kernels_of_any_length_equal_the_plain_sum(spark, cutoff):
    arrays = [wave(k, n) for k, n in enumerate((1, 2, 3, 5, 24, 60, 61))]
    got = lines(gauss.gaussian_filter(curves(spark, *arrays), "Waviness", cutoff))
    for k, a in enumerate(arrays):
        if cutoff < 1e4:
            np.testing.assert_allclose(got[k], reflected_mean(a, cutoff, 0.1), rtol=1e-6, atol=1e-6, err_msg=f"{len(a)}")
        else:
            ends = np.r_[a[:-1], a[:0:-1]] if len(a) > 1 else a
            np.testing.assert_allclose(got[k], np.full(len(a), ends.astype(float).mean()), rtol=1e-6, atol=1e-6)


def test_longest_cutoff_runs_and_non_finite_samples_reach_all(spark):
    a, up, both = wave(1, 300), wave(2, 300), wave(3, 300)
    a[7], up[9], both[1], both[2] = NAN, np.inf, np.inf, -np.inf
    got = lines(gauss.gaussian_filter(curves(spark, a, up, both, wave(4, 300)), "Waviness", 1e9))
    assert np.isnan(got[0]).all() and np.isposinf(got[1]).all() and np.isnan(got[2]).all() and np.isfinite(got[3]).all()
    rough = lines(gauss.gaussian_filter(curves(spark, wave(5, 300_000)), "Roughness", 1e9))[0]
    assert rough.astype(float).mean() == pytest.approx(0, abs=1e-2)


def walked_peaks(line, fraction):
    """Prominence and width by walking sample by sample."""
    ok = np.isfinite(line)
    if len(line) < 3 or not ok.any() or not line[ok].max() > line[ok].min():
        return []
    out = []
    for i in peaks.local_maxima(line).tolist():
        v, low = line[i], []
        for side in (-1, 1):
            j, least = i + side, v
            while 0 <= j < len(line) and line[j] <= v:
                least = min(least, line[j]) if ok[j] else least
                j += side
            low.append(least)
        prominence = v - max(low)
        if prominence < fraction * (line[ok].max() - line[ok].min()):
            continue
        level, ends = v - prominence * 0.5, []
        for side in (-1, 1):
            j = i + side
            while 0 <= j < len(line) and level < line[j] < v:
                j += side
            if not (0 <= j < len(line) and line[j] <= level):
                ends.append(NAN)
                continue
            inner, z = line[j - side], line[j]
            with np.errstate(invalid="ignore"):
                drop = float(np.float32(inner) - np.float32(z))
                ends.append(j + (level - z) / drop if side < 0 else j - 1 + (inner - level) / drop)
        out.append((i, v, prominence, ends[1] - ends[0] if prominence > 0 else NAN))
    return out


def test_peaks_equal_walks_sample_by_sample():
    rng = np.random.default_rng(0)
    for t in range(600):
        n = rng.integers(1, 50)
        line = (rng.integers(0, 6, n) if t % 2 else rng.normal(size=n)).astype(np.float32).astype(float)
        for k, bad in ((3, NAN), (5, np.inf), (7, -np.inf)):
            if t % k == 0:
                line[rng.random(n) < 0.08] = bad
        fraction = (0.0, 0.1, 0.5)[t % 3]
        got = [tuple(p.values()) for p in peaks.peaks_of(line, fraction)]
        np.testing.assert_array_equal(np.array(got).reshape(-1, 4), np.array(walked_peaks(line, fraction)).reshape(-1, 4))


def test_noise_of_a_whole_chunk_takes_milliseconds():
    import time
    line = np.random.default_rng(1).normal(size=65_536)
    took = []
    for _ in range(3):
        start = time.process_time()
        peaks.peaks_of(line, 0.1)
        took.append(time.process_time() - start)
    assert min(took) < 0.2  # tens of milliseconds on an idle core


def test_range_statistics_over_several_chunks(spark, monkeypatch):
    """Packed by seven samples: the same values as in one piece, also where the maximum or a crossing is at a border of chunks."""
    arrays = [wave(k, n, gaps=g) for k, (n, g) in enumerate(((80, 0), (61, 5), (9, 0), (35, 30)))]
    arrays.append(np.array([0, 1, 2, 3, 4, 5, 6, 9, 6, 5, 4, 3, 2, 1, 0, 0.0], dtype=np.float32))
    for start, count in ((0, 200), (3, 40), (7, 7)):
        c = curves(spark, *arrays, origin=0.4)
        want = {r["dataset_id"]: r for r in curve.range_statistics(c, start, count).collect()}
        monkeypatch.setattr(curve, "CHUNK", 7)
        got = {r["dataset_id"]: r for r in curve.range_statistics(c, start, count).collect()}
        monkeypatch.undo()
        assert got.keys() == want.keys()
        for k, r in want.items():
            np.testing.assert_allclose([got[k][f] for f in sorted(r.asDict())], [r[f] for f in sorted(r.asDict())], rtol=1e-9, err_msg=f"{k} {start}")


def test_baseline_works_on_a_bounded_part_of_a_batch():
    import pandas as pd

    sizes = [10, baseline.WORK + 5, 32, 32] + [32] * 10_000
    cols = [pd.Series([np.zeros(n) for n in sizes], dtype=object), pd.Series(range(len(sizes)))]
    parts = list(baseline.portions(*cols))
    assert [k for _, at in parts for k in at] == list(range(len(sizes)))
    assert all(len(z) == 1 or sum(map(len, z)) <= baseline.WORK for z, _ in parts) and len(parts) < 10


def test_walks_meet_an_outline_together(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    top, bottom = rng.normal(2, 1, 90), rng.normal(-2, 1, 90)
    units = spark.createDataFrame([(1, 0, k, float(t), float(m)) for k, (t, m) in enumerate(zip(top, bottom))], "dataset_id bigint, g int, c int, top double, bottom double")
    asked = [(int(rng.integers(90)), int(rng.choice([-1, 1])), float(rng.normal(3.5, 0.7)), float(rng.normal(-4, 0.5)), 9.0) for _ in range(400)]
    walks = spark.createDataFrame([(n, *v) for n, v in enumerate(asked)], "i int, at int, side int, value double, level double, low double").select(
        F.lit(1).cast("bigint").alias("dataset_id"), F.lit(0).alias("g"), "at", F.struct("i", "side", "value", "level", "low").alias("k"))
    for width in (False, True):
        routed = peaks._route(units, walks, width)
        assert "collect_list(struct(k" in routed._jdf.queryExecution().executedPlan().toString()  # not one outline per walk
        got = {r.k.i: (r.unit, r.k.low) for r in routed.collect()}
        for n, (at, side, value, level, low) in enumerate(asked):
            unit, j = None, at + side
            while 0 <= j < 90 and unit is None:
                if top[j] >= value or bottom[j] <= level if width else top[j] > value:
                    unit = j
                else:
                    low, j = min(low, bottom[j]), j + side
            assert got[n] == (unit, low)
