import math

import numpy as np
import pytest
from helpers import grids, images, lines
from pyspark.sql import functions as F

from heightfield.operators import flatten, gauss, grains, pixel, profiles, spectral, stencil

NAN = math.nan


def rough(seed, h, w):
    return np.random.default_rng(seed).normal(size=(h, w))


def test_four_quarter_turns_are_the_identity_and_coordinates_travel(spark):
    im = images(spark, np.arange(12).reshape(3, 4))
    turned = im
    for _ in range(4):
        turned = pixel.transform(turned, "Rotate90Cw")
    np.testing.assert_array_equal(grids(turned)[0], grids(im)[0])
    axes = turned.scans.first()
    assert (axes["x"]["direction"], axes["x"]["count"]) == ("Forward", 4)
    once = pixel.transform(im, "Rotate90Cw")
    np.testing.assert_array_equal(grids(once)[0], np.rot90(np.arange(12).reshape(3, 4), -1))
    assert once.scans.first()["x"]["direction"] == "Reverse"


def test_crop_clamps_and_moves_reversed_origin(spark):
    im = images(spark, np.arange(30).reshape(5, 6), np.zeros((1, 1)))
    flipped = pixel.transform(im, "FlipHorizontal")
    out = pixel.crop(flipped, 2, 1, 10, 2)
    np.testing.assert_array_equal(grids(out)[0], np.arange(30).reshape(5, 6)[:, ::-1][1:3, 2:])
    ax = out.scans.collect()
    assert len(ax) == 1 and ax[0]["x"]["count"] == 4 and ax[0]["x"]["origin"] == pytest.approx(0.0)


def test_pixel_math_passes_non_finite_through(spark):
    a = [[1.0, NAN, -3.0, math.inf]]
    np.testing.assert_allclose(grids(pixel.pixel_math(images(spark, a), "Invert"))[0], [[-3, NAN, 1, math.inf]])
    np.testing.assert_allclose(grids(pixel.pixel_math(images(spark, a), "Scale", 2))[0], [[2, NAN, -6, math.inf]])


def pad(a, r):
    return np.pad(a.astype(np.float64), r, mode="edge")


@pytest.mark.parametrize("kind,size", [("Mean", 3), ("Mean", 9), ("Gaussian", 5), ("Median", 3), ("Sobel", 3), ("Sharpen", 3), ("Laplacian", 3)])
def test_filters_match_brute_force_across_tiles(spark, kind, size):
    a = rough(1, 11, 14).astype(np.float32)
    if kind == "Median":
        a[2, 3] = a[2, 4] = NAN
    got = grids(stencil.spatial_filter(images(spark, a), kind, size, tile=4))[0]
    r = size // 2
    p = pad(a, r)
    want = np.empty_like(a, dtype=np.float64)
    for y in range(11):
        for x in range(14):
            n = p[y:y + size, x:x + size]
            if kind == "Mean":
                want[y, x] = n.mean()
            elif kind == "Gaussian":
                s = max(size / 6, 0.5)
                d = np.arange(size) - r
                k = np.exp(-(d[:, None] ** 2 + d**2) / (2 * s * s))
                want[y, x] = (k * n).sum() / k.sum()
            elif kind == "Median":
                want[y, x] = sorted(n.ravel(), key=lambda v: -math.inf if math.isnan(v) else v)[size * size // 2]
            elif kind == "Sobel":
                gx = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
                gy = (n[2] - n[0]) @ [1, 2, 1]
                want[y, x] = math.hypot(gx, gy)
            else:
                cross = n[0, 1] + n[2, 1] + n[1, 0] + n[1, 2]
                want[y, x] = 5 * n[1, 1] - cross if kind == "Sharpen" else cross - 4 * n[1, 1]
    np.testing.assert_allclose(got, want, rtol=1e-5, atol=1e-5)


def test_median_window_of_mostly_nan_is_nan(spark):
    a = np.full((3, 3), NAN)
    a[0, 0] = 1.0
    assert np.isnan(grids(stencil.spatial_filter(images(spark, a), "Median"))[0][2, 2])


def test_deglitch_repairs_spikes_and_keeps_hopeless_pixels(spark):
    a = np.zeros((7, 7))
    a[3, 3], a[1, 5] = 100.0, NAN
    b = np.full((3, 3), NAN)
    got = grids(stencil.deglitch(images(spark, a, b), 3.0, tile=2))
    assert (got[0] == 0).all() and np.isnan(got[1]).all()


@pytest.mark.parametrize("order", range(9))
def test_surface_flatten_equals_dense_least_squares(spark, order):
    a = (rough(2, 14, 11) + np.add.outer(np.arange(14) ** 2 * 0.05, np.arange(11) * 0.3)).astype(np.float32)
    got = grids(flatten.flatten(images(spark, a), "Surface", order))[0]
    y, x = np.mgrid[:14, :11] / 10.0 - 0.5
    basis = np.stack([(x**i * y**j).ravel() for i in range(order + 1) for j in range(order + 1 - i)], axis=1)
    fit = basis @ np.linalg.lstsq(basis, a.ravel().astype(float), rcond=None)[0]
    np.testing.assert_allclose(got, a - fit.reshape(a.shape), atol=5e-6)


@pytest.mark.parametrize("orientation", ["FastAxis", "SlowAxis"])
@pytest.mark.parametrize("scope", ["Line", "Whole"])
@pytest.mark.parametrize("order", [0, 1, 5, 8])
def test_line_flatten_equals_polyfit(spark, scope, order, orientation):
    a = rough(4, 12, 10).astype(np.float32)
    got = grids(flatten.flatten(images(spark, a), scope, order, orientation))[0]
    b = a if orientation == "FastAxis" else a.T
    t = np.linspace(-1, 1, b.shape[1])
    rows = b.astype(float) if scope == "Line" else np.repeat(b.mean(axis=0, dtype=float)[None], len(b), axis=0)
    fit = np.polynomial.legendre.legval(t, np.polynomial.legendre.legfit(t, rows.T, order))
    want = b - fit
    np.testing.assert_allclose(got, want if orientation == "FastAxis" else want.T, atol=5e-6)


def test_golden_fit_recovers_polynomials_exactly(spark):
    x = np.arange(10.0)
    a = np.stack([2 + 3 * x, 1 - x + 0.5 * x * x])
    assert np.abs(grids(flatten.flatten(images(spark, a), "Line", 2))[0]).max() < 1e-5
    y, x = np.mgrid[:4, :4]
    assert np.abs(grids(flatten.flatten(images(spark, 1 + 2 * x - y + 0.5 * x * y), "Surface", 2))[0]).max() < 1e-5


def test_flatten_leaves_short_lines_poisons_nan_and_keeps_midpoint(spark):
    a = np.array([[1.0, 5.0], [2.0, 9.0]])
    im = images(spark, a)
    np.testing.assert_array_equal(grids(flatten.flatten(im, "Line", 3))[0], a)
    assert [r["code"] for r in flatten.flatten_warnings(im, "Line", 3).collect()] == ["flatten.underdetermined"]
    b = rough(6, 3, 5)
    b[1, 2] = NAN
    got = grids(flatten.flatten(images(spark, b), "Line", 1))[0]
    assert np.isnan(got[1]).all() and np.isfinite(got[[0, 2]]).all()
    c = rough(7, 6, 8).astype(np.float32) + 40
    kept = grids(flatten.flatten(images(spark, c), "Line", 1, basement="PreserveOriginalMidpoint"))[0]
    assert (kept.max() + kept.min()) / 2 == pytest.approx((c.max() + c.min()) / 2, abs=1e-4)


def reference_areal(a, cutoff, dx, dy):
    def run(rows, step):
        sigma = gauss.GAUSS_ALPHA * cutoff / step
        half = max(1, math.ceil(4 * sigma))
        k = np.arange(-half, half + 1)
        w = np.exp(-np.pi * k * k / sigma**2)
        n = rows.shape[1]
        at = gauss.mirror(np.arange(n)[:, None] + k, n)
        return (rows[:, at] * w).sum(axis=2) / w.sum()

    return run(run(a.astype(float), dx).T, dy).T


@pytest.mark.parametrize("tile", [4, 256])
def test_areal_gaussian_wraps_and_splits(spark, tile):
    a = rough(8, 9, 13).astype(np.float32)
    got = grids(gauss.gaussian_areal_filter(images(spark, a, dx=0.1, dy=200.0, y_unit="nm"), "Waviness", 2.6, tile=tile))[0]
    np.testing.assert_allclose(got, reference_areal(a, 2.6, 0.1, 0.2), atol=1e-6)


def test_filtered_roughness_leaves_out_unfit_images(spark):
    im = images(spark, rough(1, 20, 20), rough(1, 3, 20))
    assert [r["dataset_id"] for r in gauss.filtered_roughness(im, 0.8).collect()] == [0]


@pytest.mark.parametrize("shape", [(6, 10), (1, 5), (9, 1), (8, 16)])
def test_fourier_all_pass_is_identity_and_bands_match_fft2(spark, shape):
    a = rough(9, *shape).astype(np.float32)
    np.testing.assert_allclose(grids(spectral.fourier_filter(images(spark, a), "LowPass", 0, 1, block=8))[0], a, atol=1e-6)
    h, w = (1 << (s - 1).bit_length() for s in shape)
    grid = np.full((h, w), a.mean(dtype=float))
    grid[:shape[0], :shape[1]] = a
    r = np.hypot(np.fft.fftfreq(h)[:, None] * 2, np.fft.fftfreq(w)[None] * 2) / math.sqrt(2)
    want = np.fft.ifft2(np.fft.fft2(grid) * ((r < 0.2) | (r > 0.6))).real[:shape[0], :shape[1]]
    np.testing.assert_allclose(grids(spectral.fourier_filter(images(spark, a), "BandStop", 0.2, 0.6, block=8))[0], want, atol=1e-6)


def test_psd_peak_and_parseval(spark):
    x = np.arange(64)
    a = np.tile(3 * np.cos(2 * np.pi * 7 * x / 64), (8, 1))
    rows = spectral.line_psd(images(spark, a, dx=0.5)).orderBy("k").collect()
    psd = np.array([r["psd"] for r in rows])
    assert psd.argmax() + 1 == 7 and psd.sum() / 32 == pytest.approx(a.var(), rel=1e-6)
    gap = a.copy()
    gap[2, 3] = NAN
    assert {r["rows_used"] for r in spectral.line_psd(images(spark, gap)).collect()} == {7}
    assert spectral.psd_warnings(images(spark, gap)).first()["code"] == "psd.skipped-lines"


def brute_grains(mask):
    label, n = np.zeros(mask.shape, dtype=int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            cy, cx = stack.pop()
            for ny in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                    if mask[ny, nx] and not label[ny, nx]:
                        label[ny, nx] = n
                        stack.append((ny, nx))
    return label, n


def test_run_labelling_equals_flood_fill():
    rng = np.random.default_rng(11)
    for density in (0.2, 0.4, 0.6, 0.9):
        mask = rng.random((17, 23)) < density
        y, x, length, parent = grains.label_runs(mask)
        got = np.zeros(mask.shape, dtype=int)
        got[mask] = np.repeat(parent, length) + 1
        want, n = brute_grains(mask)
        assert len(np.unique(parent)) == n
        assert len(set(zip(got[mask], want[mask]))) == n


def test_one_grain_over_all_tiles_meets_in_bounded_groups(spark):
    big = np.ones((64, 96))
    big[0, 0] = 0.0
    got = grains.grain_table(images(spark, big, np.eye(30)), 0.5, tile=4, fan=2).collect()
    assert sorted((r["dataset_id"], r["area"], r["height_sum"]) for r in got) == [(0, 64 * 96 - 1, 64 * 96 - 1.0), (1, 30, 30.0)]
    # what a super-tile of 8 pixels hands on is its rim, whatever lies inside
    y, x = np.mgrid[:8, :8]
    _, root, ry, _, name = grains._merge([y[:4].ravel(), y[4:].ravel()], [x[:4].ravel(), x[4:].ravel()], [np.zeros(32), np.full(32, 5)], 8)
    assert len(ry) == 28 and set(name) == {0} and list(root) == [0]


@pytest.mark.parametrize("tile, fan", [(3, 2), (3, 16), (2, 3), (64, 16)])
def test_snaking_grains_merge_across_tiles(spark, tile, fan):
    spiral = np.zeros((12, 12))
    spiral[1, 1:11] = spiral[1:11, 10] = spiral[10, 2:11] = spiral[4:11, 2] = spiral[4, 2:8] = 1
    spots = np.eye(12)
    spots[0, 11] = 1
    flat = np.full((4, 5), 2.5)
    holes = np.where(np.arange(36).reshape(6, 6) % 7 == 0, NAN, spiral[:6, :6])
    arrays = [spiral, spots, flat, holes]
    got = {r["dataset_id"]: r for r in grains.grains(images(spark, *arrays), 0.5, 2, tile=tile, fan=fan).collect()}
    for k, a in enumerate(arrays):
        lo, hi = np.nanmin(a), np.nanmax(a)
        mask = np.nan_to_num(a, nan=-9) >= lo + 0.5 * (hi - lo)
        label, n = brute_grains(mask)
        areas = [int((label == g).sum()) for g in range(1, n + 1)]
        kept = [v for v in areas if v >= 2]
        assert got[k]["GrainCount"] == len(kept)
        assert got[k]["Coverage"] == pytest.approx(sum(kept) / np.isfinite(a).sum())


def test_line_profile_far_edge_gaps_and_length(spark):
    a = np.add.outer(np.arange(5.0) * 10, np.arange(6.0))
    a[0, 0] = NAN
    im = images(spark, a, dx=0.1, dy=300.0, y_unit="nm")
    asked = spark.createDataFrame([(7, 0, 0.0, 0.0, 5.0, 4.0, 5), (8, 0, -3.0, 4.0, 99.0, 4.0, 11), (9, 0, 2.0, 2.0, 2.0, 2.0, 4)],
                                  "line_id int, dataset_id bigint, x0 double, y0 double, x1 double, y1 double, samples int")
    out = profiles.line_profiles(im, asked)
    got = lines(out)
    assert math.isnan(got[7][0]) and set(got) == {7, 8}
    np.testing.assert_allclose(got[7][1:], [11.25, 22.5, 33.75, 45.0], rtol=1e-6)
    np.testing.assert_allclose(got[8], 40 + np.linspace(0, 5, 11), rtol=1e-6)
    step = {r["dataset_id"]: r["x"]["step"] for r in out.scans.collect()}
    assert step[7] == pytest.approx(math.hypot(0.5, 1.2) / 4)


def test_preview_and_quicklook(spark):
    im = images(spark, np.arange(70).reshape(7, 10))
    nodes = pixel.preview(im, 4).toPandas()
    assert sorted(set(nodes["y"])) == [0, 2, 4, 6] and sorted(set(nodes["x"])) == [0, 3, 6, 9]
    rgb = pixel.quicklook(images(spark, [[0.0, NAN, 1.0]]), "no such map").orderBy("x").collect()
    assert [tuple(r)[3:] for r in rgb] == [(0, 0, 0), (0, 0, 0), (255, 255, 254)]


def test_filters_reach_the_scan(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/pixels"
    im = images(spark, rough(1, 6, 6))
    im.pixels.write.parquet(folder)
    stored = im.with_pixels(spark.read.parquet(folder).withColumn("unused", F.lit(1)))
    plan = pixel.crop(stored, 1, 1, 2, 2).pixels._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,1)" in plan and "Exchange" not in plan


def test_lines_beyond_the_broadcast_bound_read_only_tiles_they_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    im = images(spark, rng.normal(size=(40, 50)), rng.normal(size=(12, 9)))
    drawn = spark.createDataFrame([(1, 0, 1.0, 2.0, 47.5, 3.5, 60), (2, 0, 3.0, 1.0, 3.0, 39.0, 17), (3, 1, 0.0, 0.0, 8.0, 11.0, 30)],
                                  "line_id int, dataset_id bigint, x0 double, y0 double, x1 double, y1 double, samples int")
    want = lines(profiles.line_profiles(im, drawn))
    monkeypatch.setattr(profiles, "CORNER_ROWS", 0)
    monkeypatch.setattr(profiles, "TILE", 8)
    pruned = profiles.line_profiles(im, drawn)
    assert "LeftSemi" in pruned.samples._jdf.queryExecution().executedPlan().toString()
    got = lines(pruned)
    for k in want:
        np.testing.assert_array_equal(got[k], want[k])


def test_tiles_reach_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    from heightfield.plans.layout import halo_tiles

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        pixels = spark.range(2560 * 1024).select(F.lit(1).alias("dataset_id"), F.floor(F.col("id") / 1024).cast("int").alias("y"), (F.col("id") % 1024).cast("int").alias("x"),
                                                 F.lit(0.5).cast("float").alias("z"), F.lit(1024).alias("w"), F.lit(2560).alias("h"))
        tiles = halo_tiles(pixels).select("p", "z").repartition(1)  # 40 tiles of half a megabyte, for one task
        sizes = tiles.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    finally:
        if before is not None:
            spark.conf.set(key, before)
    assert sum(r.n for r in sizes) > 20e6 and max(r.n for r in sizes) < 18e6
