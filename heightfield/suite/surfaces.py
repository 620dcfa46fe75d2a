"""Neighbourhood, levelling, spectral and grain queries on images."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from heightfield.functions.regions import ellipse, rectangle
from heightfield.model import ImageSet
from heightfield.operators import flatten, gauss, grains, profiles, spectral, stencil
from heightfield.operators.statistics import areal_roughness
from heightfield.sources.tables import embedding_images
from heightfield.suite import query
from heightfield.suite.images import PROFILE, drawn_lines
from heightfield.suite.sql import AREAL, PIX, PX, moments, r

# Spikes and drop-outs planted by pixel position, the same on both sides.
HOLES = "CASE WHEN (x * 7 + y * 13) % 101 = 0 THEN CAST('nan' AS FLOAT) WHEN (x * 5 + y * 11) % 89 = 0 THEN z + CAST(2.5 AS FLOAT) ELSE z END"


def spiked(spark, path) -> ImageSet:
    images = embedding_images(spark, path)
    return images.with_pixels(images.pixels.select("dataset_id", "y", "x", F.expr(HOLES).alias("z")))


def near(radius: int, source: str = "px") -> str:
    """CTE nb: the edge-replicated neighbourhood of every pixel, one row per offset."""
    span = f"range({-radius}, {radius + 1})"
    return f"""
off AS (SELECT dy, dx FROM (SELECT unnest({span}) AS dy), (SELECT unnest({span}) AS dx)),
at_ AS MATERIALIZED (SELECT c.dataset_id, c.y, c.x, c.z AS own, dy, dx, CAST(greatest(0, least(h - 1, c.y + dy)) AS INT) AS ny,
        CAST(greatest(0, least(w - 1, c.x + dx)) AS INT) AS nx FROM {source} c JOIN dims USING (dataset_id) CROSS JOIN off),
nb AS (SELECT c.dataset_id, c.y, c.x, own, dy, dx, q.z FROM at_ c JOIN {source} q ON q.dataset_id = c.dataset_id AND q.y = ny AND q.x = nx)"""


def _gauss_sql(size: int) -> str:
    s = max(size / 6.0, 0.5)
    return f"sum(exp(-(dx * dx + dy * dy) / (2.0 * {s} * {s})) * z) / sum(exp(-(dx * dx + dy * dy) / (2.0 * {s} * {s})))"


def box(size: int) -> str:
    """Weighted in kernel order: a mean of floats can fall exactly between two floats, so the order decides."""
    return f"sum(CAST(1.0 AS DOUBLE) / {size * size} * z ORDER BY dy, dx)"


SX = "sum(CAST(dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END AS DOUBLE) * z)"
SY = "sum(CAST(dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END AS DOUBLE) * z)"
FILTERS = {
    "mean_5": ("Mean", 5, box(5)), "gaussian_7": ("Gaussian", 7, _gauss_sql(7)),
    "median_3": ("Median", 3, "median(z)"), "median_5": ("Median", 5, "median(z)"),
    "sharpen": ("Sharpen", 3, "sum(CASE WHEN dx = 0 AND dy = 0 THEN 5.0 WHEN dx = 0 OR dy = 0 THEN -1.0 ELSE 0.0 END * CAST(z AS DOUBLE))"),
    "laplacian": ("Laplacian", 3, "sum(CASE WHEN dx = 0 AND dy = 0 THEN -4.0 WHEN dx = 0 OR dy = 0 THEN 1.0 ELSE 0.0 END * CAST(z AS DOUBLE))"),
    "sobel": ("Sobel", 3, f"sqrt(pow({SX}, 2) + pow({SY}, 2))"),
}


def _filter(name: str, kind: str, size: int, expr: str) -> None:
    key = {"Sobel": "w2", "Median": "w3"}.get(kind, "w1")

    @query(f"{key}_{name}", f"WITH {PX}, {near(size // 2)}, o AS (SELECT dataset_id, y, x, CAST({expr} AS FLOAT) AS z FROM nb GROUP BY 1, 2, 3) {PIX} o")
    def _(spark, path):
        return stencil.spatial_filter(embedding_images(spark, path), kind, size).pixels


for _name, (_kind, _size, _expr) in FILTERS.items():
    _filter(_name, _kind, _size, _expr)


@query("w1_mean_3_small_tiles", f"WITH {PX}, {near(1)}, o AS (SELECT dataset_id, y, x, CAST({box(3)} AS FLOAT) AS z FROM nb GROUP BY 1, 2, 3) {PIX} o")
def _(spark, path):
    return stencil.spatial_filter(embedding_images(spark, path), "Mean", 3, tile=16).pixels


@query("w4_deglitch", f"""WITH {PX}, hx AS MATERIALIZED (SELECT dataset_id, y, x, {HOLES} AS z FROM px), {near(1, 'hx')},
sd AS (SELECT dataset_id, stddev_pop(CAST(z AS DOUBLE)) AS sd FROM hx WHERE NOT isnan(z) GROUP BY 1),
md AS (SELECT dataset_id, y, x, any_value(own) AS own, median(CAST(z AS DOUBLE)) FILTER (NOT isnan(z)) AS md FROM nb GROUP BY 1, 2, 3),
o AS (SELECT md.dataset_id, y, x, CASE WHEN md IS NOT NULL AND (isnan(own) OR (sd > 0 AND abs(own - md) > 2.0 * sd)) THEN CAST(md AS FLOAT) ELSE own END AS z
      FROM md JOIN sd USING (dataset_id)) {PIX} o""")
def _(spark, path):
    return stencil.deglitch(spiked(spark, path), 2.0).pixels


# --- F: levelling ------------------------------------------------------------------------------

def _base(key: str, along: str) -> str:
    return f"""
fit AS (SELECT dataset_id, {key}, regr_slope(CAST(z AS DOUBLE), {along}) AS s, regr_intercept(CAST(z AS DOUBLE), {along}) AS c FROM px GROUP BY 1, 2),
o AS (SELECT px.dataset_id, y, x, z - CAST(c + s * {along} AS FLOAT) AS z FROM px JOIN fit USING (dataset_id, {key}))"""


@query("f3_flatten_line", f"WITH {PX}, {_base('y', 'x')} {PIX} o")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path)).pixels


@query("f3_flatten_line_slow_axis", f"WITH {PX}, {_base('x', 'y')} {PIX} o")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), orientation="SlowAxis").pixels


@query("f3_flatten_line_order0", f"""WITH {PX}, fit AS (SELECT dataset_id, y, avg(CAST(z AS DOUBLE)) AS c FROM px GROUP BY 1, 2),
o AS (SELECT px.dataset_id, y, x, z - CAST(c AS FLOAT) AS z FROM px JOIN fit USING (dataset_id, y)) {PIX} o""")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), order=0).pixels


# Second order by the normal equations in a centred and scaled x, solved with Cramer's rule.
QUAD = """
u AS (SELECT dataset_id, y, x, z, (x - 31.5) / 32.0 AS t FROM px),
sm AS (SELECT dataset_id, y, CAST(count(*) AS DOUBLE) AS s0, sum(t) AS s1, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4,
              sum(CAST(z AS DOUBLE)) AS b0, sum(t*z) AS b1, sum(t*t*z) AS b2 FROM u GROUP BY 1, 2),
dt AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS det FROM sm),
co AS (SELECT dataset_id, y, (b0*(s2*s4 - s3*s3) - s1*(b1*s4 - s3*b2) + s2*(b1*s3 - s2*b2)) / det AS c0,
              (s0*(b1*s4 - s3*b2) - b0*(s1*s4 - s3*s2) + s2*(s1*b2 - b1*s2)) / det AS c1,
              (s0*(s2*b2 - b1*s3) - s1*(s1*b2 - b1*s2) + b0*(s1*s3 - s2*s2)) / det AS c2 FROM dt),
o AS (SELECT u.dataset_id, y, x, z - CAST(c0 + c1*t + c2*t*t AS FLOAT) AS z FROM u JOIN co USING (dataset_id, y))"""


@query("f3_flatten_line_order2", f"WITH {PX}, {QUAD} {PIX} o")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), order=2).pixels


@query("f3_flatten_whole", f"""WITH {PX}, mn AS (SELECT dataset_id, x, avg(CAST(z AS DOUBLE)) AS m FROM px GROUP BY 1, 2),
fit AS (SELECT dataset_id, regr_slope(m, x) AS s, regr_intercept(m, x) AS c FROM mn GROUP BY 1),
o AS (SELECT px.dataset_id, y, x, z - CAST(c + s * x AS FLOAT) AS z FROM px JOIN fit USING (dataset_id)) {PIX} o""")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), "Whole").pixels


# First-order surface by the three normal equations, solved with Cramer's rule.
PLANE = """
sm AS (SELECT dataset_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(x AS DOUBLE)) AS sx, sum(CAST(y AS DOUBLE)) AS sy, sum(CAST(x*x AS DOUBLE)) AS sxx,
              sum(CAST(y*y AS DOUBLE)) AS syy, sum(CAST(x*y AS DOUBLE)) AS sxy, sum(CAST(z AS DOUBLE)) AS sz, sum(x * CAST(z AS DOUBLE)) AS sxz,
              sum(y * CAST(z AS DOUBLE)) AS syz FROM px GROUP BY 1),
dt AS (SELECT *, n*(sxx*syy - sxy*sxy) - sx*(sx*syy - sxy*sy) + sy*(sx*sxy - sxx*sy) AS det FROM sm),
co AS (SELECT dataset_id, (sz*(sxx*syy - sxy*sxy) - sx*(sxz*syy - sxy*syz) + sy*(sxz*sxy - sxx*syz)) / det AS c0,
              (n*(sxz*syy - sxy*syz) - sz*(sx*syy - sxy*sy) + sy*(sx*syz - sxz*sy)) / det AS cx,
              (n*(sxx*syz - sxz*sxy) - sx*(sx*syz - sxz*sy) + sz*(sx*sxy - sxx*sy)) / det AS cy FROM dt),
o AS (SELECT px.dataset_id, y, x, z, z - CAST(c0 + cx*x + cy*y AS FLOAT) AS f FROM px JOIN co USING (dataset_id))"""


@query("f2_flatten_surface", f"WITH {PX}, {PLANE}, o2 AS (SELECT dataset_id, y, x, f AS z FROM o) {PIX} o2")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), "Surface").pixels


@query("f3_flatten_surface_midpoint", f"""WITH {PX}, {PLANE}, sh AS (SELECT dataset_id,
    CAST((max(CAST(z AS DOUBLE)) + min(CAST(z AS DOUBLE))) / 2 - (max(CAST(f AS DOUBLE)) + min(CAST(f AS DOUBLE))) / 2 AS FLOAT) AS s FROM o GROUP BY 1),
o2 AS (SELECT o.dataset_id, y, x, f + s AS z FROM o JOIN sh USING (dataset_id)) {PIX} o2""")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), "Surface", basement="PreserveOriginalMidpoint").pixels


# --- W6, W7: areal Gaussian ----------------------------------------------------------------------

def kernel(cutoff: float, step: float) -> str:
    """CTEs kr (half kernel) and nm (sum of the full kernel)."""
    sigma = math.sqrt(math.log(2) / math.pi) * cutoff / step
    half = max(1, math.ceil(4 * sigma))
    return f"""
kr AS (SELECT k, exp(-pi() / ({sigma!r} * {sigma!r}) * k * k) AS e FROM (SELECT unnest(range({half + 1})) AS k)),
nm AS (SELECT sum(CASE WHEN k = 0 THEN e ELSE 2 * e END) AS nm FROM kr)"""


# Mirror samples are added in the type of the column (FLOAT samples, DOUBLE sums), then weighted.
def paired(a: str, q: str) -> str:
    return f"sum(CASE WHEN k = 0 THEN e * {a} ELSE e * ({a} + {q}) END ORDER BY k) / any_value(nm)"


def reflect(i: str, n: str) -> str:
    last = f"({n} - 1)"
    return f"({last} - abs({last} - ((({i}) % (2 * {last}) + 2 * {last}) % (2 * {last}))))"


def areal(cutoff: float, band: str) -> str:
    out = "CAST(mean AS FLOAT)" if band == "Waviness" else "CAST(z - mean AS FLOAT)"
    return f"""{kernel(cutoff, 0.1)},
rp AS MATERIALIZED (SELECT c.dataset_id, c.y, c.x, any_value(c.z) AS z, {paired('a.z', 'q.z')} AS v FROM px c JOIN dims USING (dataset_id), kr, nm, px a, px q
       WHERE a.dataset_id = c.dataset_id AND a.y = c.y AND a.x = {reflect('c.x - k', 'w')}
         AND q.dataset_id = c.dataset_id AND q.y = c.y AND q.x = {reflect('c.x + k', 'w')} GROUP BY 1, 2, 3),
cp AS (SELECT c.dataset_id, c.y, c.x, any_value(c.z) AS z, {paired('a.v', 'q.v')} AS mean FROM rp c JOIN dims USING (dataset_id), kr, nm, rp a, rp q
       WHERE a.dataset_id = c.dataset_id AND a.x = c.x AND a.y = {reflect('c.y - k', 'h')}
         AND q.dataset_id = c.dataset_id AND q.x = c.x AND q.y = {reflect('c.y + k', 'h')} GROUP BY 1, 2, 3),
o AS (SELECT dataset_id, y, x, {out} AS z FROM cp)"""


@query("w6_areal_roughness_band", f"WITH {PX}, {areal(0.8, 'Roughness')} {PIX} o")
def _(spark, path):
    return gauss.gaussian_areal_filter(embedding_images(spark, path), "Roughness", 0.8).pixels


@query("w6_areal_waviness_small_tiles", f"WITH {PX}, {areal(0.4, 'Waviness')} {PIX} o")
def _(spark, path):
    return gauss.gaussian_areal_filter(embedding_images(spark, path), "Waviness", 0.4, tile=16).pixels


@query("w7_filtered_areal_roughness", f"WITH {PX}, {areal(0.8, 'Roughness')}, {moments('o')} SELECT dataset_id, {AREAL} FROM m")
def _(spark, path):
    return gauss.filtered_roughness(embedding_images(spark, path), 0.8)


@query("w7_filtered_region_roughness", f"""WITH {PX}, {areal(0.8, 'Roughness')}, rg AS (SELECT dataset_id, region_id, z FROM o, (VALUES (1), (2)) t(region_id)
    WHERE CASE region_id WHEN 1 THEN x >= 10 AND x < 50 AND y >= 5 AND y < 30 ELSE pow((x + 0.5 - 30.0) / 20.0, 2) + pow((y + 0.5 - 20.0) / 15.0, 2) <= 1 END),
    {moments('rg', 'dataset_id, region_id')} SELECT dataset_id, CAST(region_id AS BIGINT) AS region_id, {AREAL} FROM m""")
def _(spark, path):
    return gauss.filtered_roughness(embedding_images(spark, path), 0.8, [rectangle(1, 10, 5, 40, 25), ellipse(2, 10, 5, 40, 30)])


# --- X: spectra ------------------------------------------------------------------------------------

@query("x1_line_psd", f"""WITH {PX}, hx AS (SELECT dataset_id, y, x, CASE WHEN (y * 17 + dataset_id) % 23 = 0 AND x = 5 THEN CAST('nan' AS FLOAT) ELSE z END AS z FROM px),
ln AS (SELECT dataset_id, y, avg(CAST(z AS DOUBLE)) AS m FROM hx GROUP BY 1, 2 HAVING NOT isnan(avg(CAST(z AS DOUBLE)))),
ft AS (SELECT hx.dataset_id, hx.y, k, sum((z - m) * cos(2 * pi() * k * x / 64)) AS re, sum((z - m) * sin(2 * pi() * k * x / 64)) AS im
       FROM hx JOIN ln USING (dataset_id, y), (SELECT unnest(range(1, 33)) AS k) GROUP BY 1, 2, 3)
SELECT dataset_id, k, {r('k / (64 * 0.1)', 'frequency')}, {r('0.1 / 64 * (CASE WHEN k < 32 THEN 2 ELSE 1 END) * avg(re * re + im * im)', 'psd')}, count(*) AS rows_used
FROM ft GROUP BY 1, 2""")
def _(spark, path):
    images = embedding_images(spark, path)
    holes = F.when((F.col("y") * 17 + F.col("dataset_id")) % 23 == 0, F.when(F.col("x") == 5, F.lit(float("nan"))).otherwise(F.col("z"))).otherwise(F.col("z"))
    return spectral.line_psd(images.with_pixels(images.pixels.select("dataset_id", "y", "x", holes.cast("float").alias("z"))))


@query("x1_psd_axis", f"WITH {PX} SELECT dataset_id, '1/um' AS unit, {r('1 / 6.4', 'step')}, CAST(32 AS BIGINT) AS n, 'nm²·um' AS channel_unit FROM dims")
def _(spark, path):
    return spectral.psd_curves(embedding_images(spark, path)).scans.select(
        "dataset_id", "x.unit", "x.step", F.col("x.count").alias("n"), F.col("channel.unit").alias("channel_unit"))


def fourier(keep: str) -> str:
    """Direct row-column transform of the mean-padded grid (padding: next power of two of each side)."""
    return f"""
pd AS (SELECT dims.dataset_id, w, h, CAST(pow(2, ceil(log2(w))) AS BIGINT) AS m, CAST(pow(2, ceil(log2(h))) AS BIGINT) AS n, avg(CAST(z AS DOUBLE)) AS mean
       FROM dims JOIN px USING (dataset_id) GROUP BY 1, 2, 3),
gr AS MATERIALIZED (SELECT g.dataset_id, g.y, g.x, g.m, g.n, coalesce(CAST(px.z AS DOUBLE), mean) AS z FROM
       (SELECT dataset_id, m, n, mean, y, unnest(range(m)) AS x FROM (SELECT dataset_id, m, n, mean, unnest(range(n)) AS y FROM pd)) g
       LEFT JOIN px ON px.dataset_id = g.dataset_id AND px.y = g.y AND px.x = g.x),
f1 AS MATERIALIZED (SELECT dataset_id, y, n, m, u, sum(z * cos(2 * pi() * u * x / m)) AS re, -sum(z * sin(2 * pi() * u * x / m)) AS im
       FROM gr, (SELECT unnest(range(64)) AS u) GROUP BY 1, 2, 3, 4, 5),
f2 AS (SELECT dataset_id, u, v, n, m, sum(re * cos(2 * pi() * v * y / n) + im * sin(2 * pi() * v * y / n)) AS re,
              sum(im * cos(2 * pi() * v * y / n) - re * sin(2 * pi() * v * y / n)) AS im
       FROM f1 JOIN (SELECT unnest(range(256)) AS v) ON v < n GROUP BY 1, 2, 3, 4, 5),
f3 AS MATERIALIZED (SELECT * FROM (SELECT *, sqrt(pow(least(u, m - u) / (m / 2.0), 2) + pow(least(v, n - v) / (n / 2.0), 2)) / sqrt(2.0) AS rad FROM f2) WHERE {keep}),
f4 AS MATERIALIZED (SELECT dataset_id, u, y, m, sum(re * cos(2 * pi() * v * y / n) - im * sin(2 * pi() * v * y / n)) / n AS re,
              sum(im * cos(2 * pi() * v * y / n) + re * sin(2 * pi() * v * y / n)) / n AS im
       FROM f3 JOIN (SELECT unnest(range(256)) AS y) ON y < n GROUP BY 1, 2, 3, 4, f3.n),
f5 AS (SELECT dataset_id, y, x, sum(re * cos(2 * pi() * u * x / m) - im * sin(2 * pi() * u * x / m)) / m AS z
       FROM f4, (SELECT unnest(range(64)) AS x) GROUP BY 1, 2, 3, m),
o AS (SELECT px.dataset_id, px.y, px.x, CAST(coalesce(f5.z, 0) AS FLOAT) AS z FROM px LEFT JOIN f5 USING (dataset_id, y, x))"""


BANDS = {"LowPass": "rad <= 0.37", "HighPass": "rad >= 0.13", "BandPass": "rad >= 0.13 AND rad <= 0.37", "BandStop": "rad < 0.13 OR rad > 0.37"}


def _fourier(kind: str, keep: str) -> None:
    @query(f"x2_fourier_{kind.lower()}", f"WITH {PX}, {fourier(keep)} {PIX} o")
    def _(spark, path):
        return spectral.fourier_filter(embedding_images(spark, path), kind, 0.13, 0.37).pixels


for _kind, _keep in BANDS.items():
    _fourier(_kind, _keep)


@query("x2_fourier_small_blocks", f"WITH {PX}, {fourier(BANDS['BandPass'])} {PIX} o")
def _(spark, path):
    return spectral.fourier_filter(embedding_images(spark, path), "BandPass", 0.13, 0.37, block=512).pixels


# --- G1: grains --------------------------------------------------------------------------------------

GRAINS = f"""WITH RECURSIVE {PX},
lv AS (SELECT dataset_id, min(CAST(z AS DOUBLE)) + 0.62 * (max(CAST(z AS DOUBLE)) - min(CAST(z AS DOUBLE))) AS t, count(*) AS valid FROM px GROUP BY 1),
ab AS MATERIALIZED (SELECT px.dataset_id, y, x, y * 64 + x AS p, CAST(z AS DOUBLE) AS z FROM px JOIN lv USING (dataset_id) WHERE z >= t),
ed AS MATERIALIZED (SELECT a.dataset_id, a.p, b.p AS q FROM ab a JOIN ab b ON a.dataset_id = b.dataset_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
walk(dataset_id, p, q) AS (SELECT dataset_id, p, p FROM ab UNION SELECT w.dataset_id, w.p, e.q FROM walk w JOIN ed e ON w.dataset_id = e.dataset_id AND w.q = e.p),
lb AS (SELECT dataset_id, p, min(q) AS g FROM walk GROUP BY 1, 2),
gr AS (SELECT ab.dataset_id, g, count(*) AS area, sum(z) AS s FROM ab JOIN lb ON ab.dataset_id = lb.dataset_id AND ab.p = lb.p GROUP BY 1, 2)"""
GRAIN_SUMMARY = f"""{GRAINS} SELECT lv.dataset_id, count(area) AS GrainCount, {r('coalesce(sum(area), 0) / any_value(valid)', 'Coverage')},
{r('coalesce(sum(area) / count(area), 0)', 'MeanArea')}, {r('coalesce(sum(s) / sum(area), 0)', 'MeanHeight')}
FROM lv LEFT JOIN gr ON lv.dataset_id = gr.dataset_id AND area >= 3 GROUP BY 1"""


@query("g1_grains", GRAIN_SUMMARY)
def _(spark, path):
    return grains.grains(embedding_images(spark, path), 0.62, 3)


@query("g1_grains_across_tiles", GRAIN_SUMMARY)
def _(spark, path):
    return grains.grains(embedding_images(spark, path), 0.62, 3, tile=16)


@query("a11_grain_table", f"{GRAINS} SELECT dataset_id, CAST(g AS BIGINT) AS grain, area, {r('s', 'height_sum')} FROM gr")
def _(spark, path):
    return grains.grain_table(embedding_images(spark, path), 0.62, tile=32)




# --- what a non-finite sample does, and fits of higher order -------------------------------------

HOLED = (PX.replace("px AS MATERIALIZED", "p0 AS MATERIALIZED").replace("FROM px GROUP BY", "FROM p0 GROUP BY")
         + ", px AS MATERIALIZED (SELECT dataset_id, y, x, CASE WHEN dataset_id % 2 = 0 AND y = 3 AND x = 5 THEN CAST('nan' AS FLOAT) ELSE z END AS z FROM p0)")
POISONED = AREAL.replace("mean - lo", "mean - CASE WHEN isnan(hi) THEN hi ELSE lo END").replace("hi - lo", "hi - CASE WHEN isnan(hi) THEN hi ELSE lo END")


def holed(spark, path) -> ImageSet:
    """The images, every second with one missing pixel."""
    images = embedding_images(spark, path)
    hole = (F.col("dataset_id") % 2 == 0) & (F.col("y") == 3) & (F.col("x") == 5)
    return images.with_pixels(images.pixels.withColumn("z", F.when(hole, F.lit(float("nan")).cast("float")).otherwise(F.col("z"))))


@query("a4_roughness_poisoned", f"WITH {HOLED}, {moments('px')} SELECT dataset_id, {POISONED} FROM m")
def _(spark, path):
    return areal_roughness(holed(spark, path))


@query("w6_areal_filter_propagates", f"WITH {HOLED}, {areal(0.8, 'Waviness')} {PIX} o")
def _(spark, path):
    return gauss.gaussian_areal_filter(holed(spark, path), "Waviness", 0.8).pixels


@query("w7_filtered_roughness_poisoned", f"WITH {HOLED}, {areal(0.8, 'Roughness')}, {moments('o')} SELECT dataset_id, {POISONED} FROM m")
def _(spark, path):
    return gauss.filtered_roughness(holed(spark, path), 0.8)


@query("f3_flatten_surface_poisoned", f"""WITH {HOLED}, {PLANE}, o2 AS (SELECT dataset_id, y, x, f AS z FROM o) {PIX} o2""")
def _(spark, path):
    return flatten.flatten(holed(spark, path), "Surface").pixels


# Products of the first three orthogonal polynomials of a full grid; their sums over a line are closed forms of its length.
QUADRIC = """
tt AS (SELECT px.*, x - (w - 1) / 2.0 AS u, y - (h - 1) / 2.0 AS v, (w * w - 1) / 12.0 AS mu, (h * h - 1) / 12.0 AS mv FROM px JOIN dims USING (dataset_id)),
bs AS (SELECT dataset_id, y, x, z, unnest([1.0::DOUBLE, u, v, u * u - mu, u * v, v * v - mv]) AS q, unnest(range(6)) AS k FROM tt),
ft AS (SELECT dataset_id, k, sum(q * CAST(z AS DOUBLE)) / sum(q * q) AS c FROM bs GROUP BY 1, 2),
o AS (SELECT bs.dataset_id, y, x, any_value(z) - CAST(sum(c * q) AS FLOAT) AS z FROM bs JOIN ft USING (dataset_id, k) GROUP BY 1, 2, 3)"""


@query("f2_flatten_surface_order2", f"WITH {PX}, {QUADRIC} {PIX} o")
def _(spark, path):
    return flatten.flatten(embedding_images(spark, path), "Surface", 2).pixels


@query("j1_line_profiles_nan", f"WITH {HOLED}, {PROFILE}")
def _(spark, path):
    images = holed(spark, path)
    return profiles.line_profiles(images, drawn_lines(images)).samples
