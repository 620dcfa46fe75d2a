"""Curve queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heightfield.operators import baseline, curve, flatten, gauss, peaks, pixel, statistics
from heightfield.sources.tables import embedding_curves, event_curves
from heightfield.suite import query
from heightfield.suite.sql import EM, LINE, NAN, SAM, b, ev, moments, r
from heightfield.suite.surfaces import kernel, paired, reflect

OK = "isfinite(z)"


@query("a6_curve_roughness", f"WITH {ev(97)}, ok AS (SELECT * FROM cv WHERE {OK}), {moments('ok')} SELECT dataset_id, {LINE} FROM m")
def _(spark, path):
    return statistics.curve_roughness(event_curves(spark, path, gaps=97))


# Range 5..44: the nearest stopping sample on each side of the first maximum gives the half-level crossings.
RANGE = f"""
rw AS (SELECT cv.dataset_id, i, CAST(z AS DOUBLE) AS z, i * 0.1 AS xr, least(45, n) - 1 AS last FROM cv JOIN len USING (dataset_id) WHERE i >= 5 AND i < 45),
s1 AS (SELECT dataset_id, any_value(last) AS last, count(*) AS rows, count(*) FILTER ({OK}) AS n, min(z) FILTER ({OK}) AS lo, max(z) FILTER ({OK}) AS hi,
              avg(z) FILTER ({OK}) AS mean, stddev_pop(z) FILTER ({OK}) AS sd, sum(z) FILTER ({OK}) AS sy, sum(z * xr) FILTER ({OK}) AS sxy,
              CAST(CAST(max(z) FILTER (i = 5) AS FLOAT) + CAST(max(z) FILTER (i = last) AS FLOAT) AS DOUBLE) AS ends FROM rw GROUP BY 1),
s2 AS (SELECT s1.*, (SELECT min(i) FROM rw WHERE rw.dataset_id = s1.dataset_id AND z = hi) AS top, hi - (hi - lo) * 0.5 AS half FROM s1),
st AS (SELECT rw.dataset_id, max(i) FILTER (i < top) AS ls, min(i) FILTER (i > top) AS rs FROM rw JOIN s2 ON rw.dataset_id = s2.dataset_id
       WHERE NOT ({OK.replace('z', 'rw.z')} AND rw.z > half AND rw.z < hi) GROUP BY 1),
e AS (SELECT s2.*, ls, rs, l0.z AS l0, l1.z AS l1, r0.z AS r0, r1.z AS r1 FROM s2 LEFT JOIN st USING (dataset_id)
      LEFT JOIN rw l0 ON l0.dataset_id = s2.dataset_id AND l0.i = ls LEFT JOIN rw l1 ON l1.dataset_id = s2.dataset_id AND l1.i = ls + 1
      LEFT JOIN rw r0 ON r0.dataset_id = s2.dataset_id AND r0.i = rs LEFT JOIN rw r1 ON r1.dataset_id = s2.dataset_id AND r1.i = rs - 1)
SELECT dataset_id, {r('lo', 'RangeMin')}, {r('hi', 'RangeMax')}, {r('mean', 'RangeMean')}, {r('sd', 'RangeRms')}, {r('hi', 'PeakValue')},
  {r('top * 0.1', 'PeakPosition')}, {r(f'CASE WHEN rows = n THEN 0.1 * (sy - ends / 2) ELSE {NAN} END', 'Area')}, {r('sxy / sy', 'Centroid')},
  {r(f'''CASE WHEN hi > lo AND top > 5 AND top < last AND l0 <= half AND r0 <= half
      THEN 0.1 * ((rs - 1 + (r1 - half) / (CAST(r1 AS FLOAT) - CAST(r0 AS FLOAT))) - (ls + (half - l0) / (CAST(l1 AS FLOAT) - CAST(l0 AS FLOAT)))) ELSE {NAN} END''', 'Fwhm')} FROM e"""


@query("a7_range_statistics", f"WITH {ev(97)}, {RANGE}")
def _(spark, path):
    return curve.range_statistics(event_curves(spark, path, gaps=97), 5, 40)


@query("p3_crop_curve", f"WITH {ev()}, o AS (SELECT dataset_id, i - 11 AS i, z FROM cv WHERE i >= 11 AND i < 61) {SAM} o")
def _(spark, path):
    return pixel.crop_curve(event_curves(spark, path), 11, 50).samples


@query("p11_curve_points", f"WITH {ev()} SELECT dataset_id, {b('i')}, {r('i * 0.1', 'x')}, {r('z', 'z')} FROM cv")
def _(spark, path):
    return pixel.curve_points(event_curves(spark, path))


@query("p11_curve_y_range", f"WITH {ev(97)} SELECT dataset_id, {r('min(z)', 'lo')}, {r('max(z)', 'hi')} FROM cv WHERE {OK} GROUP BY 1")
def _(spark, path):
    return pixel.curve_y_range(event_curves(spark, path, gaps=97))


def gaussian(cutoff: float, band: str) -> str:
    out = "CAST(mean AS FLOAT)" if band == "Waviness" else "CAST(z - mean AS FLOAT)"
    return f"""{kernel(cutoff, 0.1)},
sm AS (SELECT c.dataset_id, c.i, any_value(n) AS n, any_value(c.z) AS z, {paired('a.z', 'q.z')} AS mean FROM cv c JOIN len USING (dataset_id), kr, nm, cv a, cv q
       WHERE a.dataset_id = c.dataset_id AND a.i = {reflect('c.i - k', 'n')} AND q.dataset_id = c.dataset_id AND q.i = {reflect('c.i + k', 'n')} GROUP BY 1, 2),
o AS (SELECT dataset_id, i, n, {out} AS z FROM sm)"""


@query("w5_profile_roughness_band", f"WITH {ev()}, {gaussian(0.8, 'Roughness')} {SAM} o")
def _(spark, path):
    return gauss.gaussian_filter(event_curves(spark, path), "Roughness", 0.8).samples


@query("w5_profile_waviness_chunked", f"WITH {ev()}, {gaussian(0.5, 'Waviness')} {SAM} o")
def _(spark, path):
    return gauss.gaussian_filter(event_curves(spark, path), "Waviness", 0.5, chunk=16).samples


@query("w8_filtered_curve_roughness", f"""WITH {ev()}, {gaussian(0.8, 'Roughness')},
wn AS (SELECT dataset_id, n, least(5, floor((n - 1) * 0.1 / 0.8)) AS sl FROM len WHERE (n - 1) * 0.1 >= 0.8),
w2 AS (SELECT *, least(n - 1, floor(sl * 0.8 / 0.1)) AS iv FROM wn),
w3 AS (SELECT *, floor((n - (iv + 1)) / 2) AS st FROM w2),
ev AS (SELECT o.dataset_id, o.z FROM o JOIN w3 USING (dataset_id) WHERE i >= st AND i < st + iv + 1), {moments('ev')}
SELECT dataset_id, {LINE}, CAST(sl AS BIGINT) AS SamplingLengths, {r('iv * 0.1', 'EvaluationLength')} FROM m JOIN w3 USING (dataset_id)""")
def _(spark, path):
    return gauss.filtered_curve_roughness(event_curves(spark, path), 0.8)


# Published five-point quadratic weights, centre and the two inward-shifted ends.
SG = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5), 2: (-3, 12, 17, 12, -3), 3: (-5, 6, 12, 13, 9), 4: (3, -5, -3, 9, 31)}
SG_SQL = ", ".join(f"({at}, {k}, CAST({w} AS DOUBLE) / 35)" for at, ws in SG.items() for k, w in enumerate(ws))
SMOOTH = f"""sw(pos, k, wt) AS (VALUES {SG_SQL}),
po AS (SELECT cv.dataset_id, i, greatest(0, least(i - 2, n - 5)) AS s FROM cv JOIN len USING (dataset_id)),
o AS (SELECT po.dataset_id, po.i, CAST(sum(CAST(wt AS DOUBLE) * q.z ORDER BY k) AS FLOAT) AS z FROM po JOIN sw ON pos = po.i - s
      JOIN cv q ON q.dataset_id = po.dataset_id AND q.i = s + k GROUP BY 1, 2)"""


@query("w10_savitzky_golay", f"WITH {EM}, {SMOOTH} {SAM} o")
def _(spark, path):
    return curve.smooth(embedding_curves(spark, path), 5, 2).samples


@query("w10_savitzky_golay_chunked", f"WITH {EM}, {SMOOTH} {SAM} o")
def _(spark, path):
    return curve.smooth(embedding_curves(spark, path), 5, 2, chunk=16).samples


def noise_sql() -> str:
    return f"""
df AS (SELECT dataset_id, abs(2.0 * CAST(z AS DOUBLE) - lag(CAST(z AS DOUBLE)) OVER w - lead(CAST(z AS DOUBLE)) OVER w) AS d FROM cv WINDOW w AS (PARTITION BY dataset_id ORDER BY i)),
ns AS (SELECT len.dataset_id, coalesce(1.482602 * median(d) FILTER (isfinite(d)) / sqrt(6.0), 0) AS sigma FROM len LEFT JOIN df USING (dataset_id) GROUP BY 1)"""


@query("w11_noise", f"WITH {ev(97)}, {noise_sql()} SELECT dataset_id, {r('sigma', 'sigma')} FROM ns")
def _(spark, path):
    return curve.noise(event_curves(spark, path, gaps=97))


@query("w11_noise_chunked", f"WITH {ev(97)}, {noise_sql()} SELECT dataset_id, {r('sigma', 'sigma')} FROM ns")
def _(spark, path):
    return curve.noise(event_curves(spark, path, gaps=97), chunk=16)


# Every walk is the stretch up to the nearest stopping sample on that side.
PEAKS = f"""{noise_sql()},
rg AS (SELECT dataset_id, max(CAST(z AS DOUBLE)) - min(CAST(z AS DOUBLE)) AS span FROM cv WHERE {OK} GROUP BY 1),
nx AS (SELECT *, lag(z) OVER w AS p, lead(z) OVER w AS f FROM cv WINDOW w AS (PARTITION BY dataset_id ORDER BY i)),
cn AS MATERIALIZED (SELECT dataset_id, i, CAST(z AS DOUBLE) AS v FROM nx WHERE isfinite(z) AND isfinite(p) AND isfinite(f) AND z > p AND z > f),
wk AS (SELECT cn.dataset_id, cn.i, cn.v, max(q.i) FILTER (q.i < cn.i) AS ls, min(q.i) FILTER (q.i > cn.i) AS rs
       FROM cn LEFT JOIN cv q ON q.dataset_id = cn.dataset_id AND (isnan(q.z) OR q.z > cn.v) GROUP BY 1, 2, 3),
pr AS MATERIALIZED (SELECT wk.dataset_id, wk.i, v, v - greatest(min(q.z) FILTER (q.i < wk.i), min(q.z) FILTER (q.i > wk.i)) AS prom
       FROM wk JOIN cv q ON q.dataset_id = wk.dataset_id AND q.i > coalesce(ls, -1) AND q.i < coalesce(rs, 1000000) GROUP BY 1, 2, 3),
kp AS MATERIALIZED (SELECT pr.*, v - prom * 0.5 AS lv FROM pr JOIN rg USING (dataset_id) WHERE span > 0 AND prom >= 0.2 * span),
sp AS (SELECT kp.dataset_id, kp.i, max(q.i) FILTER (q.i < kp.i) AS ls, min(q.i) FILTER (q.i > kp.i) AS rs
       FROM kp LEFT JOIN cv q ON q.dataset_id = kp.dataset_id AND q.i <> kp.i AND NOT (isfinite(q.z) AND q.z > lv AND q.z < v) GROUP BY 1, 2),
wd AS (SELECT kp.*, CASE WHEN prom > 0 AND l0.z <= lv AND r0.z <= lv
         THEN (rs - 1 + (r1.z - lv) / (r1.z - r0.z)) - (ls + (lv - l0.z) / (l1.z - l0.z)) ELSE {NAN} END AS width
       FROM kp JOIN sp USING (dataset_id, i)
       LEFT JOIN cv l0 ON l0.dataset_id = kp.dataset_id AND l0.i = ls LEFT JOIN cv l1 ON l1.dataset_id = kp.dataset_id AND l1.i = ls + 1
       LEFT JOIN cv r0 ON r0.dataset_id = kp.dataset_id AND r0.i = rs LEFT JOIN cv r1 ON r1.dataset_id = kp.dataset_id AND r1.i = rs - 1),
pk AS (SELECT wd.dataset_id, i, i * 0.1 AS position, v AS value, prom AS prominence, width * 0.1 AS width, CASE WHEN sigma > 0 THEN prom / sigma ELSE CAST('inf' AS DOUBLE) END AS snr
       FROM wd JOIN ns USING (dataset_id)),
fl AS (SELECT * FROM pk WHERE snr >= 0.5 AND (isnan(width) OR width >= 0.12))"""
PEAK_ROWS = f"""WITH {ev(97)}, {PEAKS} SELECT dataset_id, {b('i')}, {r('position', 'position')}, {r('value', 'value')}, {r('prominence', 'prominence')},
    {r('width', 'width')}, {r('snr', 'snr')} FROM fl"""


@query("w12_peak_table", PEAK_ROWS)
def _(spark, path):
    return peaks.peak_table(event_curves(spark, path, gaps=97), 0.2, 0.5, 0.12)


@query("w12_peak_table_chunked", PEAK_ROWS)
def _(spark, path):
    return peaks.peak_table(event_curves(spark, path, gaps=97), 0.2, 0.5, 0.12, chunk=8)


@query("w12_dominant_peak", f"""WITH {ev(97)}, {PEAKS}, bs AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY prominence DESC, i) AS k FROM fl),
cn2 AS (SELECT dataset_id, count(*) AS n FROM fl GROUP BY 1)
SELECT len.dataset_id, coalesce(cn2.n, 0) AS PeakCount, {r(f'coalesce(position, {NAN})', 'DominantPosition')}, {r(f'coalesce(value, {NAN})', 'DominantValue')},
  {r(f'coalesce(prominence, {NAN})', 'DominantProminence')}, {r(f'coalesce(width, {NAN})', 'DominantWidth')}, {r(f'coalesce(snr, {NAN})', 'DominantSnr')}
FROM len LEFT JOIN cn2 USING (dataset_id) LEFT JOIN bs ON bs.dataset_id = len.dataset_id AND k = 1""")
def _(spark, path):
    curves = event_curves(spark, path, gaps=97)
    return peaks.dominant_peaks(curves, peaks.peak_table(curves, 0.2, 0.5, 0.12))


@query("f4_flatten_curve", f"""WITH {ev(97)}, fit AS (SELECT dataset_id, regr_slope(CAST(z AS DOUBLE), i) AS s, regr_intercept(CAST(z AS DOUBLE), i) AS c
    FROM cv WHERE {OK} GROUP BY 1), o AS (SELECT cv.dataset_id, i, CAST(z - (c + s * i) AS FLOAT) AS z FROM cv JOIN fit USING (dataset_id)) {SAM} o""")
def _(spark, path):
    return flatten.flatten_curves(event_curves(spark, path, gaps=97)).samples


@query("f1_curve_mean_level", f"""WITH {ev(97)}, fit AS (SELECT dataset_id, avg(CAST(z AS DOUBLE)) AS c FROM cv WHERE {OK} GROUP BY 1),
    o AS (SELECT cv.dataset_id, i, CAST(z - c AS FLOAT) AS z FROM cv JOIN fit USING (dataset_id)) {SAM} o""")
def _(spark, path):
    return flatten.flatten_curves(event_curves(spark, path, gaps=97), 0).samples


def als_sql(rounds: int, lam: float = 1e5, p: float = 0.01) -> str:
    """Asymmetric least squares in SQL: per round one recursive pass factorises (W + lam D'D) from the first sample on,
    another substitutes back from the last; both carry the two latest rows."""
    out = f"""{ev(97)},
hs AS (SELECT cv.dataset_id, i, n, z, isfinite(z) AS ok, CASE WHEN isfinite(z) THEN CAST(z AS DOUBLE) ELSE 0 END AS y,
    CAST(i <= n - 3 AS INT) AS h0, CAST(i >= 1 AND i <= n - 2 AS INT) AS h1, CAST(i >= 2 AS INT) AS h2 FROM cv JOIN len USING (dataset_id)),
bd AS MATERIALIZED (SELECT *, {lam!r} * (h0 + 4 * h1 + h2) AS b0, {lam!r} * (-2 * h1 - 2 * h2) AS b1, {lam!r} * h2 AS b2 FROM hs),
w0 AS (SELECT dataset_id, i, CAST(ok AS DOUBLE) AS w FROM bd)"""
    for k in range(1, rounds + 1):
        out += f""",
a{k} AS MATERIALIZED (SELECT bd.dataset_id, bd.i, n, w + b0 AS d0, b1 AS d1, b2 AS d2, w * y AS r FROM bd JOIN w{k - 1} USING (dataset_id, i)),
f{k}(dataset_id, i, n, pv, pv1, l1, l2, g, g1) AS (
    SELECT dataset_id, i, n, d0, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), r, CAST(0 AS DOUBLE) FROM a{k} WHERE i = 0
    UNION ALL SELECT dataset_id, i, n, d0 - m2 * d2 - e / pv * e, pv, e / pv, m2, r - m2 * g1 - e / pv * g, g FROM (
        SELECT a.dataset_id, a.i, a.n, a.d0, a.d2, a.r, f.pv, f.g, f.g1, CASE WHEN a.i >= 2 THEN a.d2 / f.pv1 ELSE 0 END AS m2,
               a.d1 - CASE WHEN a.i >= 2 THEN a.d2 / f.pv1 ELSE 0 END * f.pv1 * f.l1 AS e
        FROM f{k} f JOIN a{k} a ON a.dataset_id = f.dataset_id AND a.i = f.i + 1)),
s{k} AS MATERIALIZED (SELECT * FROM f{k}),
b{k}(dataset_id, i, x, x1, l1, l2, l2n) AS (
    SELECT dataset_id, i, g / pv, CAST(0 AS DOUBLE), l1, l2, CAST(0 AS DOUBLE) FROM s{k} WHERE i = n - 1
    UNION ALL SELECT s.dataset_id, s.i, s.g / s.pv - b.l1 * b.x - b.l2n * b.x1, b.x, s.l1, s.l2, b.l2 FROM b{k} b JOIN s{k} s ON s.dataset_id = b.dataset_id AND s.i = b.i - 1),
w{k} AS MATERIALIZED (SELECT bd.dataset_id, bd.i, z, x, CASE WHEN NOT ok THEN 0 WHEN y > x THEN {p!r} ELSE 1 - {p!r} END::DOUBLE AS w FROM bd JOIN b{k} USING (dataset_id, i))"""
    return f"""WITH RECURSIVE {out}, enough AS (SELECT dataset_id FROM cv WHERE {OK} GROUP BY 1 HAVING count(*) >= 3)
SELECT dataset_id, {b('i')}, round_even(CASE WHEN dataset_id IN (SELECT dataset_id FROM enough) THEN CAST(z - x AS FLOAT) ELSE z END::DOUBLE * 1e3, 0) / 1e3 + 0.0 AS z FROM w{rounds}"""


def level_rows(curves):
    """Samples to three decimals: the two solves agree to far less than that, but not to the last bit."""
    return curves.samples.select("dataset_id", "i", (F.rint(F.col("z").cast("double") * 1e3) / 1e3 + F.lit(0.0)).alias("z"))


@query("f5_als_baseline", als_sql(10))
def _(spark, path):
    return level_rows(baseline.baseline(event_curves(spark, path, gaps=97)))


@query("f5_als_baseline_chunked", als_sql(4))
def _(spark, path):
    return level_rows(baseline.baseline(event_curves(spark, path, gaps=97), iterations=4, chunk=32))


@query("w5_applicability", f"""WITH {EM} SELECT dataset_id, {r(repr(math.sqrt(math.log(2) / math.pi)), 'alpha')} FROM len
    WHERE 0.2 >= 2 * 0.03 * (1 + dataset_id % 6)""")
def _(spark, path):
    given = embedding_curves(spark, path)
    x = F.col("x").withField("step", 0.03 * (1 + F.col("dataset_id") % 6))
    scans = gauss.filterable_curves(given.with_samples(given.samples, given.scans.withColumn("x", x)), 0.2)
    return scans.select("dataset_id", F.lit(gauss.GAUSS_ALPHA).alias("alpha"))


@query("w5_filter_propagates", f"WITH {ev(97)}, {gaussian(0.8, 'Waviness')} {SAM} o")
def _(spark, path):
    return gauss.gaussian_filter(event_curves(spark, path, gaps=97), "Waviness", 0.8).samples


def folded(cutoffs: str, reach_of: str) -> str:
    """Mean line of a kernel of any length: its weights are summed per place of the reflected curve's period first."""
    sigma = f"({math.sqrt(math.log(2) / math.pi)!r} * cut / 0.1)"
    return f"""ct AS (SELECT dataset_id, n, 2 * (n - 1) AS p, {cutoffs} AS cut FROM len),
fk AS (SELECT n, p, cut, k, exp(-pi() * k * k / ({sigma} * {sigma})) AS wt FROM (SELECT *, unnest(range(-{reach_of}, {reach_of} + 1)) AS k FROM (SELECT DISTINCT n, p, cut FROM ct))),
fw AS MATERIALIZED (SELECT n, cut, ((k % p) + p) % p AS m, sum(wt) AS wt FROM fk GROUP BY ALL),
ft AS MATERIALIZED (SELECT n, cut, sum(wt) AS wt FROM fw GROUP BY ALL),
sm AS (SELECT c.dataset_id, c.i, any_value(c.z) AS z, sum(fw.wt * CAST(q.z AS DOUBLE)) / any_value(ft.wt) AS mean
    FROM cv c JOIN ct USING (dataset_id) JOIN fw ON fw.n = ct.n AND fw.cut = ct.cut JOIN ft ON ft.n = ct.n AND ft.cut = ct.cut
    JOIN cv q ON q.dataset_id = c.dataset_id AND q.i = ct.n - 1 - abs(ct.n - 1 - (c.i + fw.m) % ct.p) GROUP BY 1, 2)"""


LONG = folded("40.0", "ceil(4 * 0.46971863934982566 * cut / 0.1)::BIGINT")


@query("w5_long_cutoff", f"WITH {ev()}, {LONG} SELECT dataset_id, {b('i')}, round_even(CAST(z - mean AS FLOAT)::DOUBLE * 1e3, 0) / 1e3 + 0.0 AS z FROM sm")
def _(spark, path):
    return level_rows(gauss.gaussian_filter(event_curves(spark, path), "Roughness", 40.0))


@query("w5_cutoff_beyond_all", f"""WITH {ev(97)}, av AS (SELECT dataset_id, sum(CASE WHEN i IN (0, n - 1) THEN 1 ELSE 2 END * CAST(z AS DOUBLE)) / any_value(2 * (n - 1)) AS mean
    FROM cv JOIN len USING (dataset_id) GROUP BY 1) SELECT dataset_id, {b('i')}, round_even(CAST(mean AS FLOAT)::DOUBLE * 1e3, 0) / 1e3 + 0.0 AS z FROM cv JOIN av USING (dataset_id)""")
def _(spark, path):
    return level_rows(gauss.gaussian_filter(event_curves(spark, path, gaps=97), "Waviness", 1e9))


# The first four orthogonal polynomials of a complete curve, centred on its middle.
CUBIC = """
tt AS (SELECT cv.*, i - (n - 1) / 2.0 AS t FROM cv JOIN len USING (dataset_id)),
mm AS (SELECT dataset_id, avg(t * t) AS m2, avg(t * t * t * t) / avg(t * t) AS m4 FROM tt GROUP BY 1),
bs AS (SELECT tt.dataset_id, i, z, unnest([1.0::DOUBLE, t, t * t - m2, t * (t * t - m4)]) AS q, unnest(range(4)) AS k FROM tt JOIN mm USING (dataset_id)),
ft AS (SELECT dataset_id, k, sum(q * CAST(z AS DOUBLE)) / sum(q * q) AS c FROM bs GROUP BY 1, 2),
o AS (SELECT bs.dataset_id, i, CAST(any_value(z) - sum(c * q) AS FLOAT) AS z FROM bs JOIN ft USING (dataset_id, k) GROUP BY 1, 2)"""


@query("f1_curve_order3", f"WITH {ev()}, {CUBIC} {SAM} o")
def _(spark, path):
    return flatten.flatten_curves(event_curves(spark, path), 3).samples


# A straight line through the finite samples of each window of five; fewer than two of them leave the sample as it is.
@query("w10_savitzky_golay_gaps", f"""WITH {ev(7)}, po AS (SELECT cv.dataset_id, i, z, greatest(0, least(i - 2, n - 5)) AS s FROM cv JOIN len USING (dataset_id)),
ft AS (SELECT po.dataset_id, po.i, any_value(po.z) AS z, count(q.i) AS n, regr_intercept(CAST(q.z AS DOUBLE), q.i - po.i) AS c FROM po
    LEFT JOIN cv q ON q.dataset_id = po.dataset_id AND q.i BETWEEN s AND s + 4 AND isfinite(q.z) GROUP BY 1, 2)
SELECT dataset_id, {b('i')}, round_even((CASE WHEN n >= 2 THEN CAST(c AS FLOAT) ELSE z END::DOUBLE + 0.000137) * 1e3, 0) / 1e3 + 0.0 AS z FROM ft""")
def _(spark, path):
    smooth = curve.smooth(event_curves(spark, path, gaps=7), 5, 1)
    # averages of two-decimal values often end in a five: both sides are shifted off these before they are rounded
    return smooth.samples.select("dataset_id", "i", (F.rint((F.col("z").cast("double") + 0.000137) * 1e3) / 1e3 + F.lit(0.0)).alias("z"))


@query("f5_warnings", f"""WITH {ev(2)}, k AS (SELECT len.dataset_id, n, count(z) FILTER ({OK}) AS ok FROM len JOIN cv USING (dataset_id) GROUP BY 1, 2)
SELECT dataset_id, 'profile-baseline.non-finite' AS code FROM k WHERE ok < n UNION ALL SELECT dataset_id, 'profile-baseline.low-rank' FROM k WHERE ok < 3""")
def _(spark, path):
    return baseline.baseline_warnings(event_curves(spark, path, gaps=2))
