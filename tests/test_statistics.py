import math

import numpy as np
import pytest
from helpers import curves, images

from heightfield.functions.regions import ellipse, polygon, rectangle
from heightfield.operators import regions, statistics

# Published golden cases, input and (min, max, p2p, mid, mean, mad, rms, skewness, kurtosis).
NAN, INF = math.nan, math.inf
GOLDEN = {
    "ramp-16": (list(range(16)), (0, 15, 15, 7.5, 7.5, 4, 4.6097722286464435, 0, 1.7905882352941178)),
    "mixed-8": ([1.5, -2, 3.25, 0, 4.5, -1.25, 2, 0.75],
                (-2, 4.5, 6.5, 1.25, 1.09375, 1.71875, 2.049914251255403, 0.09465573375062034, 1.9832823399722914)),
    "constant-4": ([5] * 4, (5, 5, 0, 5, 5, 0, 0, NAN, NAN)),
    "with-nan": ([1, 2, NAN, 4], (NAN,) * 9),
    "with-inf": ([1, 2, INF, 4], (1, INF, INF, INF, INF, NAN, NAN, NAN, NAN)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_moments(spark, name):
    data, want = GOLDEN[name]
    row = statistics.image_moments(images(spark, [data])).first()
    got = [row[c] for c in ("lo", "hi", "p2p", "mid", "mean", "sa", "sq", "skew", "kurt")]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
    assert math.isnan(statistics.image_point_average(images(spark, [data])).first()["rz_points"])


def brute_points(z):
    d = z.ravel().astype(np.float64)
    d = d - d.mean()
    runs = np.split(d, np.flatnonzero(np.diff(d > 0)) + 1)
    ups = sorted((r.max() for r in runs if r[0] > 0), reverse=True)[:5]
    downs = sorted(r.min() for r in runs if not r[0] > 0)[:5]
    return (sum(ups) - sum(downs)) / 5 if len(ups) == len(downs) == 5 else NAN


@pytest.mark.parametrize("chunk", [1, 2, 7, 65536])
def test_point_average_merges_runs_across_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(statistics, "FAN", 3)
    rng = np.random.default_rng(3)
    arrays = [rng.normal(size=(9, 13)).cumsum(axis=1), np.repeat(rng.normal(size=(4, 9)), 3, axis=1), np.zeros((3, 3))]
    got = {r["dataset_id"]: r["rz_points"] for r in statistics.image_point_average(images(spark, *arrays), chunk=chunk).collect()}
    for k, a in enumerate(arrays):
        np.testing.assert_allclose(got[k], brute_points(np.asarray(a, dtype=np.float32)), rtol=1e-6)


def test_histogram_folds_last_edge(spark):
    rows = statistics.histogram(images(spark, [np.arange(10)], [[2.0, 2.0]]), 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 2, 2, 2, 2] and {r["dataset_id"] for r in rows} == {0}
    assert rows[0]["center"] == pytest.approx(0.9)


def test_large_catalog_plan_gives_the_same_rows(spark, monkeypatch):
    """Beyond the broadcast bound every operator joins on (dataset, block) instead."""
    from heightfield.plans import layout

    rng = np.random.default_rng(5)
    arrays = [rng.normal(size=(20, 37)), rng.normal(size=(5, 6))]
    small = statistics.areal_roughness(images(spark, *arrays)).orderBy("dataset_id").collect()
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(layout, "TILE", 8)
    big = statistics.areal_roughness(images(spark, *arrays))
    assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_allclose(np.array(big.orderBy("dataset_id").collect()), np.array(small), rtol=1e-9)


def test_curve_roughness_skips_gaps_and_reports_empty(spark):
    c = curves(spark, [1, 2, NAN, 3], [NAN, NAN])
    rows = {r["dataset_id"]: r for r in statistics.curve_roughness(c).collect()}
    assert rows[0]["Ra"] == pytest.approx(2 / 3) and math.isnan(rows[1]["Ra"])


def test_square_polygon_equals_rectangle_and_off_grid_is_empty(spark):
    im = images(spark, np.zeros((12, 15)))
    shapes = [rectangle(1, 2, 3, 5, 4), polygon(2, [(2, 3), (7, 3), (7, 7), (2, 7)]), rectangle(3, 100, 100, 5, 5),
              ellipse(4, 0, 0, 0, 5), rectangle(5, -1e20, -1e20, 2e20, 2e20), ellipse(6, 2, 2, 8, 8)]
    got = {r["region_id"]: r["n"] for r in regions.mask_counts(im, shapes).collect()}
    y, x = np.mgrid[:12, :15] + 0.5
    assert got == {1: 20, 2: 20, 3: 0, 4: 0, 5: 180, 6: int((((x - 6) / 4) ** 2 + ((y - 6) / 4) ** 2 <= 1).sum())}
    with pytest.raises(ValueError):
        polygon(1, [(0, 0), (1, 1)])


def test_region_tiles_cover_regions(spark, monkeypatch):
    from heightfield.operators import regions as module

    monkeypatch.setattr(module, "TILE", 4)
    im = images(spark, np.arange(300).reshape(15, 20))
    region = rectangle(1, 3.2, 2.7, 11.5, 9.9)
    got = regions.masked_pixels(im, regions.region_table(im, [region])).select("y", "x").toPandas()
    y, x = np.mgrid[:15, :20] + 0.5
    want = (x >= 3.2) & (x < 14.7) & (y >= 2.7) & (y < 12.6)
    assert len(got) == want.sum() and want[got["y"], got["x"]].all()


def test_roi_statistics_finite_only_and_empty(spark):
    a = np.arange(20, dtype=float).reshape(4, 5)
    a[1, 1] = NAN
    b = np.full((4, 5), NAN)
    rows = {r["dataset_id"]: r for r in regions.roi_statistics(images(spark, a, b), "Rectangle", 1, 1, 2, 2).collect()}
    assert rows[0]["PixelCount"] == 3 and rows[0]["Mean"] == pytest.approx(np.nanmean(a[1:3, 1:3]))
    assert rows[1]["PixelCount"] == 0 and math.isnan(rows[1]["Sq"])
    assert regions.roi_statistics(images(spark, a), "Rectangle", 5, 0, 1, 1).count() == 0


