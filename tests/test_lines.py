"""Packed lines give what pixels give, and their operators move no samples along X."""

import numpy as np
import pytest
from helpers import grids, images

from heightfield.operators import flatten, gauss, spectral
from heightfield.plans import layout, lines


def both(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(23, 40)), rng.normal(size=(9, 33)), rng.normal(size=(70, 3))
    a[4, 7], b[2, 0] = np.nan, np.inf
    loose = images(spark, a, b, c)
    return loose, loose.with_pixels(loose.pixels, lines=lines.lines_of(loose))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(text, name):
    """The part of a plan that feeds an operator."""
    rows = text.splitlines()
    at = next(k for k, r in enumerate(rows) if name in r)
    depth = lambda r: len(r) - len(r.lstrip(" :+-*()0123456789"))
    return "\n".join(rows[at + 1:at + 1 + next((k for k, r in enumerate(rows[at + 1:]) if depth(r) <= depth(rows[at])), len(rows))])


def test_packing_and_unpacking_keep_every_sample(spark):
    loose, packed = both(spark)
    a, b = grids(loose), grids(lines.unpacked(packed.lines))
    for k in a:
        np.testing.assert_array_equal(a[k], b[k])
    short = loose.with_pixels(loose.pixels.filter("not (dataset_id = 2 and x = 1)"))
    assert np.isnan(grids(lines.unpacked(lines.lines_of(short)))[2][:, 1]).all()


@pytest.mark.parametrize("basement", flatten.BASEMENTS)
@pytest.mark.parametrize("order", [0, 1, 4, 8])
def test_line_levelling_agrees_with_that_of_pixels(spark, basement, order):
    loose, packed = both(spark)
    want, got = (flatten.flatten(s, "Line", order, basement=basement) for s in (loose, packed))
    want, cells, kept = grids(want), grids(got), grids(lines.unpacked(got.lines))
    for k in want:
        np.testing.assert_allclose(cells[k], want[k], atol=2e-6)
        np.testing.assert_array_equal(cells[k], kept[k])


def test_filters_and_spectra_agree_and_a_smaller_catalog_drops_other_lines(spark):
    loose, packed = both(spark)
    fewer = packed.among(packed.scans.filter("dataset_id < 2"))
    for work in (lambda s: gauss.gaussian_areal_filter(s, "Waviness", 0.4), lambda s: spectral.fourier_filter(s, "HighPass", 0.3),
                 lambda s: flatten.flatten(s, "Line", 1)):
        want, got = grids(work(loose)), grids(work(fewer))
        assert set(got) == {0, 1}
        for k in got:
            np.testing.assert_allclose(got[k], want[k], atol=1e-6)
    key = lambda r: (r.dataset_id, r.k)
    want, got = (sorted(spectral.line_psd(s).collect(), key=key) for s in (loose, packed))
    np.testing.assert_allclose([tuple(r) for r in got], [tuple(r) for r in want], rtol=1e-9)


def test_no_samples_are_exchanged_along_lines(spark):
    _, packed = both(spark)
    stored = packed.with_pixels(packed.pixels, lines=spark.createDataFrame(packed.lines.collect(), packed.lines.schema))
    assert "Exchange" not in below(plan(spectral.line_psd(stored)), "MapInArrow")
    assert "Exchange" in below(plan(spectral.line_psd(packed)), "MapInArrow")  # pixels must meet to become lines
    assert "Exchange hashpartitioning" not in plan(flatten.flatten(stored, "Line", 2).pixels)


def test_large_catalogs_join_by_blocks_of_lines(spark, monkeypatch):
    loose, packed = both(spark)
    want = grids(gauss.gaussian_areal_filter(packed, "Roughness", 0.4))
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(layout, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(lines, "TILE", 8)
    got = grids(gauss.gaussian_areal_filter(packed, "Roughness", 0.4))
    for k in want:
        np.testing.assert_array_equal(got[k], want[k])
