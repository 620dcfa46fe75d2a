"""Operators beyond the broadcast bound: joins on (dataset, block) must give the same rows."""

import numpy as np
import pandas as pd
import pytest
from helpers import curves, images

from heightfield import model
from heightfield.functions.regions import ellipse, rectangle
from heightfield.operators import baseline, curve, flatten, gauss, grains, peaks, pixel, regions, spectral, statistics, stencil
from heightfield.plans import layout

RNG = np.random.default_rng(12)
ARRAYS = [RNG.normal(size=(23, 19)).astype(np.float32), RNG.normal(size=(9, 30)).astype(np.float32), np.zeros((4, 4), dtype=np.float32)]
LINES = [RNG.normal(size=70).cumsum().astype(np.float32), RNG.normal(size=25).astype(np.float32)]
SHAPES = [rectangle(1, 2, 2, 9, 12), ellipse(2, -3, 1, 14, 10)]

IMAGE_OPS = {
    "histogram": lambda d: statistics.histogram(d, 7),
    "points": statistics.image_point_average,
    "regions": lambda d: regions.region_roughness(d, SHAPES),
    "roi": lambda d: regions.roi_statistics(d, "Ellipse", 1, 1, 9, 6),
    "invert": lambda d: pixel.pixel_math(d).pixels,
    "turn": lambda d: pixel.transform(d).pixels,
    "quicklook": pixel.quicklook,
    "preview": lambda d: pixel.preview(d, 5),
    "median": lambda d: stencil.spatial_filter(d, "Median", 3, tile=8).pixels,
    "deglitch": lambda d: stencil.deglitch(d, 1.5, tile=8).pixels,
    "surface": lambda d: flatten.flatten(d, "Surface", 2, basement="PreserveOriginalMidpoint").pixels,
    "whole": lambda d: flatten.flatten(d, "Whole", 1).pixels,
    "areal": lambda d: gauss.filtered_roughness(d, 0.4, tile=8),
    "fourier": lambda d: spectral.fourier_filter(d, block=64).pixels,
    "psd": spectral.line_psd,
    "grains": lambda d: grains.grains(d, 0.6, tile=8),
}
CURVE_OPS = {
    "roughness": statistics.curve_roughness,
    "points": pixel.curve_points,
    "filter": lambda d: gauss.gaussian_filter(d, cutoff=0.4, chunk=16).samples,
    "filtered": lambda d: gauss.filtered_curve_roughness(d, 0.4, chunk=16),
    "smooth": lambda d: curve.smooth(d, chunk=16).samples,
    "noise": lambda d: curve.noise(d, 16),
    "range": lambda d: curve.range_statistics(d, 2, 20),
    "flatten": lambda d: flatten.flatten_curves(d, 2).samples,
    "peaks": lambda d: peaks.peak_table(d, 0.1, chunk=16),
    "baseline": lambda d: baseline.baseline(d, 100.0, iterations=2, chunk=16).samples,
}


def table(df) -> pd.DataFrame:
    frame = df.toPandas()
    return frame[sorted(frame.columns)].sort_values([c for c in ("dataset_id", "region_id", "y", "x", "gy", "gx", "bin", "k", "i") if c in frame]).reset_index(drop=True)


@pytest.mark.parametrize("kind,name", [*(("image", n) for n in IMAGE_OPS), *(("curve", n) for n in CURVE_OPS)])
def test_same_rows(spark, monkeypatch, kind, name):
    op = (IMAGE_OPS if kind == "image" else CURVE_OPS)[name]
    data = images(spark, *ARRAYS) if kind == "image" else curves(spark, *LINES)
    small = table(op(data))
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(model, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(layout, "TILE", 8)
    monkeypatch.setattr(layout, "CHUNK", 16)
    pd.testing.assert_frame_equal(table(op(data)), small, rtol=1e-6, atol=1e-7, check_dtype=False)
