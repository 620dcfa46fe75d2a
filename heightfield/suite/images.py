"""Pixel-wise, statistical and regional image queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heightfield.functions import units
from heightfield.functions.regions import ellipse, polygon, rectangle
from heightfield.operators import pixel, profiles, regions, registry, statistics
from heightfield.operators.lineage import descendants
from heightfield.plans.iterate import cut
from heightfield.sources.tables import embedding_curves, embedding_images, event_curves
from heightfield.suite import query
from heightfield.suite.sql import AREAL, EM, PIX, PX, b, ev, moments, point_average, r

M = moments("px")


@query("a1_summary_moments", f"WITH {PX}, {M} SELECT dataset_id, n, {r('lo', 'lo')}, {r('hi', 'hi')}, {r('hi - lo', 'p2p')}, "
       f"{r('(lo + hi) / 2', 'mid')}, {r('mean', 'mean')}, {r('sa', 'sa')}, {r('sq', 'sq')}, {r('skew', 'skew')}, {r('kurt', 'kurt')} FROM m")
def _(spark, path):
    return statistics.image_moments(embedding_images(spark, path))


@query("a1_moments_unordered", f"""
WITH hx AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DOUBLE) / 1000 AS z FROM lineitem), {moments("hx", "l_returnflag, l_linestatus")}
SELECT l_returnflag, l_linestatus, n, {r('lo', 'lo')}, {r('hi', 'hi')}, {r('hi - lo', 'p2p')}, {r('(lo + hi) / 2', 'mid')}, {r('mean', 'mean')},
       {r('sa', 'sa')}, {r('sq', 'sq')}, {r('skew', 'skew')}, {r('kurt', 'kurt')} FROM m""")
def _(spark, path):
    rows = spark.read.parquet(f"{path}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice").cast("double") / 1000).alias("z"))
    return statistics.moments(rows, ("l_returnflag", "l_linestatus"))


HIST = f"""
s AS (SELECT dataset_id, min(CAST(z AS DOUBLE)) AS lo, max(CAST(z AS DOUBLE)) AS hi FROM px GROUP BY 1),
c AS (SELECT px.dataset_id, CAST(least(floor((CAST(z AS DOUBLE) - lo) / ((hi - lo) / 16)), 15) AS BIGINT) AS bin, count(*) AS n
      FROM px JOIN s USING (dataset_id) GROUP BY 1, 2),
bins AS (SELECT dataset_id, lo, (hi - lo) / 16 AS wd, CAST(unnest(range(16)) AS BIGINT) AS bin FROM s WHERE hi > lo)
SELECT bins.dataset_id, bins.bin, {r('bins.lo + bins.bin * wd', 'lo')}, {r('bins.lo + (bins.bin + 1) * wd', 'hi')},
       {r('bins.lo + (bins.bin + 0.5) * wd', 'center')}, coalesce(c.n, 0) AS n
FROM bins LEFT JOIN c ON bins.dataset_id = c.dataset_id AND bins.bin = c.bin"""


@query("a2_histogram", f"WITH {PX}, {HIST}")
def _(spark, path):
    return statistics.histogram(embedding_images(spark, path), 16)


STAT_COLS = dict(zip(statistics.STATISTICS, ["lo", "hi", "hi - lo", "(lo + hi) / 2", "mean", "sa", "sq", "rz_points", "skew", "kurt", "n"]))


@query("a3_image_statistics", f"WITH {PX}, {M}, {point_average()} " + " UNION ALL ".join(
    f"SELECT dataset_id, '{name}' AS name, {r(expr, 'value')} FROM m JOIN bp USING (dataset_id)" for name, expr in STAT_COLS.items()))
def _(spark, path):
    return statistics.image_statistics(embedding_images(spark, path))


@query("a4_areal_roughness", f"WITH {PX}, {M} SELECT dataset_id, {AREAL} FROM m")
def _(spark, path):
    return statistics.areal_roughness(embedding_images(spark, path))


def _roi(shape: str) -> str:
    inside = "true" if shape == "Rectangle" else (
        "pow((x + 0.5 - (40 + least(40, w - 40) / 2.0)) / (least(40, w - 40) / 2.0), 2)"
        " + pow((y + 0.5 - (5 + least(30, h - 5) / 2.0)) / (least(30, h - 5) / 2.0), 2) <= 1")
    return f"""WITH {PX}, rg AS (SELECT px.dataset_id, z FROM px JOIN dims USING (dataset_id)
        WHERE x >= 40 AND x < 80 AND y >= 5 AND y < 35 AND {inside}), {moments("rg")}
    SELECT dataset_id, {r('sq', 'Sq')}, {r('sa', 'Sa')}, {r('hi - lo', 'Sz')}, {r('mean', 'Mean')}, {r('lo', 'Min')}, {r('hi', 'Max')},
           n AS PixelCount FROM m"""


@query("a5_region_statistics_rectangle", _roi("Rectangle"))
def _(spark, path):
    return regions.roi_statistics(embedding_images(spark, path), "Rectangle", 40, 5, 40, 30)


@query("a5_region_statistics_ellipse", _roi("Ellipse"))
def _(spark, path):
    return regions.roi_statistics(embedding_images(spark, path), "Ellipse", 40, 5, 40, 30)


@query("a8_point_average", f"WITH {PX}, {M}, {point_average()} SELECT dataset_id, {r('rz_points', 'rz_points')} FROM bp")
def _(spark, path):
    return statistics.image_point_average(embedding_images(spark, path))


@query("a9_column_mean", f"WITH {PX} SELECT dataset_id, {b('x', 'i')}, {r('avg(z)', 'mean')} FROM px GROUP BY dataset_id, x")
def _(spark, path):
    return statistics.column_mean(embedding_images(spark, path))


@query("a10_finite_range", f"WITH {ev(97)} SELECT dataset_id, {r('min(z)', 'lo')}, {r('max(z)', 'hi')} FROM cv WHERE NOT isnan(z) GROUP BY 1")
def _(spark, path):
    return statistics.finite_range(event_curves(spark, path, gaps=97).samples)


# --- P: pixel-wise ---------------------------------------------------------------------------

MATH = {
    "Invert": ("CAST(lo + hi - z AS FLOAT)", 0.0), "AbsoluteValue": ("abs(z)", 0.0),
    "Offset": ("CAST(CAST(z AS DOUBLE) + 1.25 AS FLOAT)", 1.25), "Scale": ("CAST(CAST(z AS DOUBLE) * -2.5 AS FLOAT)", -2.5),
}


def _math(kind: str, expr: str, amount: float) -> None:
    @query(f"p1_pixel_math_{kind.lower()}", f"""WITH {PX}, s AS (SELECT dataset_id, min(CAST(z AS DOUBLE)) AS lo, max(CAST(z AS DOUBLE)) AS hi FROM px GROUP BY 1),
        o AS (SELECT px.dataset_id, y, x, {expr} AS z FROM px JOIN s USING (dataset_id)) {PIX} o""")
    def _(spark, path):
        return pixel.pixel_math(embedding_images(spark, path), kind, amount).pixels


for _kind, (_expr, _amount) in MATH.items():
    _math(_kind, _expr, _amount)


@query("p2_crop", f"WITH {PX}, o AS (SELECT dataset_id, y - 6 AS y, x - 10 AS x, z FROM px WHERE x >= 10 AND x < 42 AND y >= 6 AND y < 206) {PIX} o")
def _(spark, path):
    return pixel.crop(embedding_images(spark, path), 10, 6, 32, 200).pixels


@query("p2_crop_axes", f"""WITH {PX} SELECT dataset_id, {r('10 * 0.1', 'x_origin')}, {b('least(100, w - 10)', 'x_count')}, {r('6 * 0.1', 'y_origin')},
       {b('least(20, h - 6)', 'y_count')} FROM dims""")
def _(spark, path):
    scans = pixel.crop(embedding_images(spark, path), 10, 6, 100, 20).scans
    return scans.select("dataset_id", *[F.col(f"{a}.{f}").alias(f"{a}_{f}") for a in "xy" for f in ("origin", "count")])


GEOM = {"FlipHorizontal": ("y", "w - 1 - x"), "FlipVertical": ("h - 1 - y", "x"), "Rotate180": ("h - 1 - y", "w - 1 - x"),
        "Rotate90Cw": ("x", "h - 1 - y"), "Rotate90Ccw": ("w - 1 - x", "y")}


def _geom(kind: str, ny: str, nx: str) -> None:
    @query(f"p4_geometry_{kind.lower()}", f"WITH {PX}, o AS (SELECT dataset_id, {ny} AS y, {nx} AS x, z FROM px JOIN dims USING (dataset_id)) {PIX} o")
    def _(spark, path):
        return pixel.transform(embedding_images(spark, path), kind).pixels


for _kind, (_ny, _nx) in GEOM.items():
    _geom(_kind, _ny, _nx)


@query("p5_cross_section_row", f"WITH {PX} SELECT dataset_id, {b('x', 'i')}, {r('z', 'z')} FROM px WHERE y = 7")
def _(spark, path):
    return pixel.cross_section(embedding_images(spark, path), "Row", 7).samples


@query("p5_cross_section_column", f"WITH {PX} SELECT dataset_id, {b('y', 'i')}, {r('z', 'z')} FROM px WHERE x = 21")
def _(spark, path):
    return pixel.cross_section(embedding_images(spark, path), "Column", 21).samples


NOTCH = [(4.0, 4.0), (60.5, 8.0), (40.0, 20.0), (58.0, 44.0), (20.0, 30.0), (6.0, 41.5)]
SHAPES = [rectangle(1, 3.25, 2.5, 30.0, 25.5), ellipse(2, -5.0, 4.0, 50.0, 60.0), polygon(3, NOTCH)]


def _poly(vertices) -> str:
    terms, (bx, by) = [], vertices[-1]
    for x, y in vertices:
        terms.append(f"CASE WHEN (({y} > y + 0.5) <> ({by} > y + 0.5)) AND x + 0.5 < ({bx} - {x}) * (y + 0.5 - {y}) / ({by} - {y}) + {x} THEN 1 ELSE 0 END")
        bx, by = x, y
    return "(" + " + ".join(terms) + ") % 2 = 1"


IN_SHAPE = f"""
CASE region_id WHEN 1 THEN x + 0.5 >= 3.25 AND x + 0.5 < 33.25 AND y + 0.5 >= 2.5 AND y + 0.5 < 28.0
 WHEN 2 THEN pow((x + 0.5 - 20.0) / 25.0, 2) + pow((y + 0.5 - 34.0) / 30.0, 2) <= 1 ELSE {_poly(NOTCH)} END"""
RG = f"rg AS (SELECT dataset_id, region_id, z FROM px, (VALUES (1), (2), (3)) t(region_id) WHERE {IN_SHAPE})"


@query("p6_p9_mask_counts", f"WITH {PX}, {RG} SELECT dataset_id, {b('region_id')}, count(*) AS n FROM rg GROUP BY 1, region_id")
def _(spark, path):
    return regions.mask_counts(embedding_images(spark, path), SHAPES)


@query("j2_region_roughness", f"WITH {PX}, {RG}, {moments('rg', 'dataset_id, region_id')} SELECT dataset_id, {b('region_id')}, {AREAL} FROM m")
def _(spark, path):
    return regions.region_roughness(embedding_images(spark, path), SHAPES)


@query("p10_calibrate", f"SELECT event_id, {r('CAST(value * 0.125 + (-3.5) AS FLOAT)', 'z')} FROM events")
def _(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet")
    return pixel.calibrate(e, "value", 0.125, -3.5).select("event_id", "z")


UNIT_PAIRS = [("nm", "um"), ("um", "nm"), ("Å", "pm"), ("degC", "K"), ("K", "degC"), ("kV", "mV"), ("1/cm", "1/m"), ("V", "nm"), ("bogus", "m")]
UNIT_SQL = ", ".join(f"({k}, '{s}', '{t}')" for k, (s, t) in enumerate(UNIT_PAIRS))
# Fixed values, written out apart from the registry under test: symbol, dimension, scale, offset.
UNIT_ROWS = """
    ('m', 'Length', 1.0::DOUBLE, 0.0::DOUBLE), ('mm', 'Length', 0.001::DOUBLE, 0.0::DOUBLE), ('um', 'Length', 1e-06::DOUBLE, 0.0::DOUBLE),
    ('nm', 'Length', 1e-09::DOUBLE, 0.0::DOUBLE), ('pm', 'Length', 1e-12::DOUBLE, 0.0::DOUBLE), ('Å', 'Length', 1e-10::DOUBLE, 0.0::DOUBLE),
    ('N', 'Force', 1.0::DOUBLE, 0.0::DOUBLE), ('mN', 'Force', 0.001::DOUBLE, 0.0::DOUBLE), ('uN', 'Force', 1e-06::DOUBLE, 0.0::DOUBLE),
    ('nN', 'Force', 1e-09::DOUBLE, 0.0::DOUBLE), ('pN', 'Force', 1e-12::DOUBLE, 0.0::DOUBLE), ('A', 'Current', 1.0::DOUBLE, 0.0::DOUBLE),
    ('mA', 'Current', 0.001::DOUBLE, 0.0::DOUBLE), ('uA', 'Current', 1e-06::DOUBLE, 0.0::DOUBLE), ('nA', 'Current', 1e-09::DOUBLE, 0.0::DOUBLE),
    ('pA', 'Current', 1e-12::DOUBLE, 0.0::DOUBLE), ('V', 'Voltage', 1.0::DOUBLE, 0.0::DOUBLE), ('mV', 'Voltage', 0.001::DOUBLE, 0.0::DOUBLE),
    ('uV', 'Voltage', 1e-06::DOUBLE, 0.0::DOUBLE), ('kV', 'Voltage', 1000.0::DOUBLE, 0.0::DOUBLE), ('Hz', 'Frequency', 1.0::DOUBLE, 0.0::DOUBLE),
    ('kHz', 'Frequency', 1000.0::DOUBLE, 0.0::DOUBLE), ('MHz', 'Frequency', 1000000.0::DOUBLE, 0.0::DOUBLE), ('Pa', 'Pressure', 1.0::DOUBLE, 0.0::DOUBLE),
    ('kPa', 'Pressure', 1000.0::DOUBLE, 0.0::DOUBLE), ('MPa', 'Pressure', 1000000.0::DOUBLE, 0.0::DOUBLE), ('GPa', 'Pressure', 1000000000.0::DOUBLE, 0.0::DOUBLE),
    ('N/m', 'Stiffness', 1.0::DOUBLE, 0.0::DOUBLE), ('1/m', 'WaveNumber', 1.0::DOUBLE, 0.0::DOUBLE), ('1/cm', 'WaveNumber', 100.0::DOUBLE, 0.0::DOUBLE),
    ('F', 'Capacitance', 1.0::DOUBLE, 0.0::DOUBLE), ('uF', 'Capacitance', 1e-06::DOUBLE, 0.0::DOUBLE), ('nF', 'Capacitance', 1e-09::DOUBLE, 0.0::DOUBLE),
    ('pF', 'Capacitance', 1e-12::DOUBLE, 0.0::DOUBLE), ('K', 'Temperature', 1.0::DOUBLE, 0.0::DOUBLE), ('degC', 'Temperature', 1.0::DOUBLE, 273.15::DOUBLE),
    ('1', 'Dimensionless', 1.0::DOUBLE, 0.0::DOUBLE)"""


@query("p12_unit_conversion", f"""WITH u(symbol, dimension, scale, off) AS (VALUES {UNIT_ROWS}), p(k, s, t) AS (VALUES {UNIT_SQL})
SELECT event_id, p.s AS source, p.t AS target, {r('CASE WHEN a.dimension = b.dimension THEN (value * a.scale + a.off - b.off) / b.scale END', 'value')},
       CASE WHEN a.symbol IS NULL OR b.symbol IS NULL THEN 'unknown unit'
            WHEN a.dimension <> b.dimension THEN 'cannot convert ' || a.dimension || ' to ' || b.dimension END AS error
FROM events JOIN p ON event_id % {len(UNIT_PAIRS)} = p.k LEFT JOIN u a ON a.symbol = p.s LEFT JOIN u b ON b.symbol = p.t""")
def _(spark, path):
    e = spark.read.parquet(f"{path}/events.parquet")
    k = (F.col("event_id") % len(UNIT_PAIRS)).cast("int")
    rows = e.select("event_id", "value", F.array(*[F.lit(s) for s, _ in UNIT_PAIRS])[k].alias("source"),
                    F.array(*[F.lit(t) for _, t in UNIT_PAIRS])[k].alias("target"))
    done = units.convert(F.col("value"), F.col("source"), F.col("target"))
    return rows.select("event_id", "source", "target", done["value"].alias("value"), done["error"].alias("error"))


LV = """s AS (SELECT dataset_id, min(CAST(z AS DOUBLE)) AS lo, max(CAST(z AS DOUBLE)) AS hi FROM px GROUP BY 1),
lv AS (SELECT px.dataset_id, y, x, z, CASE WHEN hi > lo THEN greatest(0, least(1, (CAST(z AS DOUBLE) - lo) / (hi - lo))) ELSE 0 END AS level
       FROM px JOIN s USING (dataset_id))"""


@query("p13_normalise", f"WITH {PX}, {LV} SELECT dataset_id, {b('y')}, {b('x')}, {r('z', 'z')}, {r('level', 'level')} FROM lv")
def _(spark, path):
    return pixel.normalise(embedding_images(spark, path))


# The colour ramps as functions of the level 0 to 255, before clamping.
RGB = {
    "Gold": ("i * 2", "i * 2 - 128", "i * 2 - 256"), "Grayscale": ("i", "i", "i"),
    "Aqua": ("(2.0 * i / 256 - 1) * 256", "(2.0 * i / 256 - 0.5) * 256", "2.0 * i / 256 * 256"),
    "Brown": ("i / 256.0 * 256", "(i / 256.0 * 1.5 - 0.5) * 256", "(i / 256.0 * 3 - 2) * 256"),
    "Melon": ("i * 2 - 128", "i * 2 - 256 * 0.15", "i * 2 - 256 * 0.9"),
    "Red": ("i * 2", "CASE WHEN i < 128 THEN 0 ELSE (i - 128) * 2 END", "CASE WHEN i < 128 THEN 0 ELSE (i - 128) * 2 END"),
    "Green": ("CASE WHEN i < 128 THEN 0 ELSE (i - 128) * 2 END", "i * 2", "CASE WHEN i < 128 THEN 0 ELSE (i - 128) * 2 END"),
}


def _byte(expr: str, name: str) -> str:
    return f"CAST(floor(greatest(0, least(255, {expr}))) AS BIGINT) AS {name}"


def _look(name: str, rgb) -> None:
    @query(f"p14_quicklook_{name.lower()}", f"""WITH {PX}, {LV}, ix AS (SELECT dataset_id, y, x, CAST(floor(level * 255) AS BIGINT) AS i FROM lv)
        SELECT dataset_id, {b('y')}, {b('x')}, {_byte(rgb[0], 'r')}, {_byte(rgb[1], 'g')}, {_byte(rgb[2], 'b')} FROM ix""")
    def _(spark, path):
        return pixel.quicklook(embedding_images(spark, path), name)


for _name, _rgb in RGB.items():
    _look(_name, _rgb)


def _nodes(n: str) -> str:
    return (f"(SELECT dataset_id, g, CAST(floor(g * ({n} - 1) / greatest(1.0, least({n}, 20) - 1) + 0.5) AS BIGINT) AS at "
            f"FROM (SELECT dataset_id, {n}, unnest(range(least({n}, 20))) AS g FROM dims))")


@query("p15_preview", f"""WITH {PX} SELECT px.dataset_id, gy.g AS gy, gx.g AS gx, {b('y')}, {b('x')}, {r('z', 'z')} FROM px
JOIN {_nodes('h')} gy ON gy.dataset_id = px.dataset_id AND gy.at = y JOIN {_nodes('w')} gx ON gx.dataset_id = px.dataset_id AND gx.at = x""")
def _(spark, path):
    return pixel.preview(embedding_images(spark, path), 20)


# --- J1: free lines ----------------------------------------------------------------------------

LINES = [("2.25", "1.5", "60.75", "40.25", 97), ("-10.0", "8.0", "200.0", "8.0", 64), ("33.0", "0.0", "33.0", "500.0", 41)]


PROFILE = f"""ln AS (SELECT dataset_id * 10 + k AS line_id, dataset_id, w, h,
    greatest(0.0, least(w - 1.0, x0 + dataset_id * 0.125)) AS x0, greatest(0.0, least(h - 1.0, y0)) AS y0,
    greatest(0.0, least(w - 1.0, x1)) AS x1, greatest(0.0, least(h - 1.0, y1)) AS y1, n
  FROM dims, (VALUES {', '.join(f'({k}, {a}, {c}, {d}, {e}, {n})' for k, (a, c, d, e, n) in enumerate(LINES))}) t(k, x0, y0, x1, y1, n)),
pt AS (SELECT *, unnest(range(n)) AS i FROM ln),
pp AS (SELECT *, CAST(x0 AS DOUBLE) + (CAST(i AS DOUBLE) / (n - 1)) * (CAST(x1 AS DOUBLE) - x0) AS px, CAST(y0 AS DOUBLE) + (CAST(i AS DOUBLE) / (n - 1)) * (CAST(y1 AS DOUBLE) - y0) AS py FROM pt),
ii AS MATERIALIZED (SELECT *, CAST(least(floor(px), w - 2) AS INT) AS ix, CAST(least(floor(py), h - 2) AS INT) AS iy FROM pp)
SELECT line_id AS dataset_id, i, {r('''CAST((a.z + (px - ix) * (b.z - a.z)) + (py - iy) * ((c.z + (px - ix) * (d.z - c.z))
       - (a.z + (px - ix) * (b.z - a.z))) AS FLOAT)''', 'z')}
FROM ii JOIN px a ON a.dataset_id = ii.dataset_id AND a.y = iy AND a.x = ix JOIN px b ON b.dataset_id = ii.dataset_id AND b.y = iy AND b.x = ix + 1
 JOIN px c ON c.dataset_id = ii.dataset_id AND c.y = iy + 1 AND c.x = ix JOIN px d ON d.dataset_id = ii.dataset_id AND d.y = iy + 1 AND d.x = ix + 1"""


def drawn_lines(images):
    """The lines above on every image, a little further right from image to image."""
    shapes = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), line[:4])],
                                F.lit(line[4]).alias("samples")) for k, line in enumerate(LINES)])
    return images.scans.select("dataset_id", F.explode(shapes).alias("s")).select(
        (F.col("dataset_id") * 10 + F.col("s.k")).alias("line_id"), "dataset_id", (F.col("s.x0") + F.col("dataset_id") * 0.125).alias("x0"),
        "s.y0", "s.x1", "s.y1", "s.samples")


@query("j1_line_profiles", f"WITH {PX}, {PROFILE}")
def _(spark, path):
    images = embedding_images(spark, path)
    return profiles.line_profiles(images, drawn_lines(images)).samples


# Every third image has a voltage along X, and every seventh is one pixel wide: some operations ask for lengths or lines.
@query("j4_applicable_operations", f"""WITH {PX}, o AS (SELECT dataset_id, unnest([
    'image.grains', 'image.roi-statistics', 'image.roughness', 'image.roughness-filtered',
    'image.statistics', 'reference.identity', 'image.crop', 'image.deglitch',
    'image.filter', 'image.flatten', 'image.fourier', 'image.geometry',
    'image.line-profile', 'image.pixelmath', 'image.profile', 'image.psd'
    ]) AS operation_id FROM dims)
    SELECT * FROM o WHERE NOT (dataset_id % 3 = 0 AND operation_id IN ('image.psd', 'image.line-profile', 'image.roughness-filtered'))
    AND NOT (dataset_id % 7 = 1 AND operation_id = 'image.psd')""")
def _(spark, path):
    x = F.col("x").withField("unit", F.when(F.col("dataset_id") % 3 == 0, "V").otherwise(F.col("x.unit")))
    x = x.withField("count", F.when(F.col("dataset_id") % 7 == 1, 1).otherwise(F.col("x.count")))
    return registry.standard().applicable(embedding_images(spark, path).scans.withColumn("x", x))


@query("u1_rejects", f"""WITH {EM}, o AS (SELECT dataset_id, CASE WHEN dataset_id % 5 = 0 THEN 'axis.not-length'
    WHEN 0.3 < 2 * 0.06 * (1 + dataset_id % 4) THEN 'cutoff.below-sampling' WHEN (n - 1) * 0.06 * (1 + dataset_id % 4) < 0.3 THEN 'cutoff.beyond-extent' END AS code FROM len)
    SELECT dataset_id, 'profile.roughness-filtered' AS operation_id, code, CAST(0 AS BIGINT) AS measured FROM o WHERE code IS NOT NULL
    UNION ALL SELECT dataset_id, 'profile.roughness-filtered', '', CAST(9 AS BIGINT) FROM o WHERE code IS NULL""")
def _(spark, path):
    """Members an operation cannot take are named with the reason, the others are measured."""
    given = embedding_curves(spark, path)
    d = F.col("dataset_id")
    x = F.col("x").withField("unit", F.when(d % 5 == 0, "V").otherwise("um")).withField("step", 0.06 * (1 + d % 4))
    done = registry.standard().run("profile.roughness-filtered", given.with_samples(given.samples, given.scans.withColumn("x", x)), {"cutoff": 0.3})
    counted = done.measurements.groupBy(F.col("source_id").alias("dataset_id")).agg(F.count(F.lit(1)).alias("measured"))
    none = done.rejects.select("dataset_id", "operation_id", "code", F.lit(0).cast("bigint").alias("measured"))
    return none.unionByName(counted.select("dataset_id", F.lit("profile.roughness-filtered").alias("operation_id"), F.lit("").alias("code"), "measured"))


@query("j1_line_rejects", f"""WITH {PX} SELECT dataset_id * 10 + k AS line_id, code FROM dims, (VALUES (1, 'line.no-length'), (2, 'samples.out-of-range'),
    (3, 'samples.out-of-range'), (4, 'image.unknown')) v(k, code)""")
def _(spark, path):
    images = embedding_images(spark, path)
    shapes = [(0, 0.0, 9.0, 5, 0), (1, 4.0, 4.0, 5, 0), (2, 0.0, 9.0, 1, 0), (3, 0.0, 9.0, 100_001, 0), (4, 0.0, 9.0, 5, 1_000_000)]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "x0", "x1", "samples", "shift"), s)]) for s in shapes])
    lines = images.scans.select("dataset_id", F.explode(rows).alias("s")).select(
        (F.col("dataset_id") * 10 + F.col("s.k")).alias("line_id"), (F.col("dataset_id") + F.col("s.shift")).alias("dataset_id"),
        "s.x0", F.lit(1.0).alias("y0"), "s.x1", F.lit(1.0).alias("y1"), "s.samples")
    return profiles.rejected_lines(images, lines).select("line_id", "code")


@query("u5_chain", f"""WITH {PX} SELECT dataset_id AS source_id, k AS step, k AS descendants_above FROM dims, (VALUES (0::BIGINT), (1::BIGINT), (2::BIGINT)) v(k)""")
def _(spark, path):
    """Two operations in a row: every result has its own id and its input as parent, so the walk down from the source finds both."""
    ops, images = registry.standard(), embedding_images(spark, path)
    level = ops.run("image.flatten", images, {"order": 1}).derived
    mean = ops.run("image.filter", level, {"kind": "Mean", "size": 3}).derived
    sets = [s.select(F.col("dataset_id").cast("string").alias("dataset_id"), (F.col("parent_id") if k else F.lit(None).cast("string")).alias("parent_id"), F.lit(k).alias("step"))
            for k, s in enumerate((images.scans, level.scans, mean.scans))]
    table = cut(sets[0].unionByName(sets[1]).unionByName(sets[2]))
    roots = table.filter("step = 0").select("dataset_id")
    below = descendants(table.select("dataset_id", "parent_id"), roots).join(table, "dataset_id").select("dataset_id", "parent_id", "step")
    first = below.filter("step = 1").select("dataset_id", F.col("parent_id").alias("source_id"), F.lit(1).alias("n"))
    second = below.filter("step = 2").join(first.select(F.col("dataset_id").alias("parent_id"), "source_id"), "parent_id").select("dataset_id", "source_id", F.lit(2).alias("n"))
    rows = roots.select("dataset_id", F.col("dataset_id").alias("source_id"), F.lit(0).alias("n")).unionByName(first).unionByName(second)
    return rows.select(F.col("source_id").cast("bigint").alias("source_id"), F.col("n").alias("step"), F.col("n").alias("descendants_above"))


@query("u4_measurements", f"""WITH {PX}, {M} """ + " UNION ALL ".join(
    f"SELECT dataset_id AS source_id, 'image.roughness' AS operation_id, '{n}' AS name, {r(e, 'value')}, '{u}' AS unit FROM m" for n, e, u in [
        ("Sq", "sq", "nm"), ("Sa", "sa", "nm"), ("Sp", "hi - mean", "nm"), ("Sv", "mean - lo", "nm"), ("Sz", "hi - lo", "nm"), ("Ssk", "skew", "1"), ("Sku", "kurt", "1")]))
def _(spark, path):
    return registry.standard().run("image.roughness", embedding_images(spark, path)).measurements.drop("artifact_id")


@query("u5_provenance_steps", f"""WITH {PX} SELECT dataset_id AS input_dataset_id, 'image.flatten' AS operation_id, CAST(1 AS BIGINT) AS operation_version,
    p.parameter, {r('p.value', 'value')}, p.label, CASE WHEN h <= 4 THEN 'flatten.underdetermined' ELSE '' END AS warnings
    FROM dims, (VALUES ('scope', 0, 'Line'), ('order', 4, NULL), ('orientation', 1, 'SlowAxis'), ('basement', 0, 'RegressionToZero')) p(parameter, value, label)""")
def _(spark, path):
    from heightfield.operators.lineage import enum_labels

    ops = registry.standard()
    steps = ops.run("image.flatten", embedding_images(spark, path), {"order": 4, "orientation": "SlowAxis"}).steps
    flat = steps.select("input_dataset_id", "operation_id", "operation_version", F.explode("parameters").alias("parameter", "value"),
                        F.concat_ws(",", "warnings").alias("warnings"))
    named = enum_labels(flat, ops.enum_codes(spark))
    return named.select("input_dataset_id", "operation_id", "operation_version", "parameter", "value", "label", "warnings")


# Recorded parameter sets, one per event: some values are out of range, unknown, fractional or not finite.
@query("u2_parameter_problems", """WITH s AS (SELECT event_id, event_id % 13 - 2 + CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0 END AS ord, event_id % 5 AS scp,
    CASE WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE event_id % 17 * 0.1 END AS thr FROM events)
SELECT event_id AS set_id, 'image.flatten' AS operation_id, 'order' AS parameter, CASE WHEN ord <> floor(ord) THEN 'not a whole number' WHEN ord < 0 THEN 'too small' ELSE 'too large' END AS problem
    FROM s WHERE ord <> floor(ord) OR ord < 0 OR ord > 8
UNION ALL SELECT event_id, 'image.flatten', 'scope', 'no such choice' FROM s WHERE scp > 2
UNION ALL SELECT event_id, 'image.grains', 'threshold', CASE WHEN isinf(thr) THEN 'not finite' ELSE 'too large' END FROM s WHERE thr > 1
UNION ALL SELECT event_id, 'image.grains', 'colour', 'unknown parameter' FROM s WHERE event_id % 19 = 0
UNION ALL SELECT event_id, 'image.melt', 'order', 'unknown operation' FROM s WHERE event_id % 23 = 0""")
def _(spark, path):
    k = F.col("event_id")
    cases = [("image.flatten", "order", k % 13 - 2 + F.when(k % 7 == 0, 0.5).otherwise(0.0), None), ("image.flatten", "scope", k % 5, None),
             ("image.grains", "threshold", F.when(k % 11 == 0, float("inf")).otherwise(k % 17 * 0.1), None), ("image.grains", "colour", F.lit(1), k % 19 == 0),
             ("image.melt", "order", F.lit(1), k % 23 == 0)]
    one = [F.struct(F.lit(o).alias("operation_id"), F.lit(p).alias("parameter"), v.cast("double").alias("value")) for o, p, v, _ in cases]
    kept = F.array_compact(F.array(*[x if when is None else F.when(when, x) for x, (*_, when) in zip(one, cases)]))
    sets = spark.read.parquet(f"{path}/events.parquet").select(k.alias("set_id"), F.explode(kept).alias("s")).select("set_id", "s.*")
    return registry.standard().problems(sets)


@query("u3_listing", f"""WITH {EM}, o AS (SELECT unnest(['curve.peaks', 'curve.range-statistics', 'profile.roughness', 'profile.roughness-filtered', 'profile.baseline', 'profile.crop',
    'profile.filter', 'profile.flatten', 'profile.smooth']) AS operation_id, unnest(range(9)) AS position, unnest(['Peaks', 'Range-statistics', 'Roughness', 'Roughness-filtered',
    'Baseline', 'Crop', 'Filter', 'Flatten', 'Smooth']) AS label) SELECT dataset_id, position, operation_id, label FROM len, o""")
def _(spark, path):
    return registry.standard().listing(embedding_curves(spark, path).scans)


@query("f7_labels", f"""WITH {PX}, n AS (SELECT unnest(['boundedPointAverageRoughness', 'count', 'kurtosis', 'max', 'mean', 'meanAbsoluteDeviation', 'mid', 'min', 'peakToPeak', 'rms', 'skewness']) AS name)
SELECT dataset_id, upper(name[1]) || regexp_replace(name[2:], '([^A-Z])([A-Z])', '\\1 \\2', 'g') AS label FROM dims, n""")
def _(spark, path):
    return statistics.image_statistics(embedding_images(spark, path)).select("dataset_id", registry.humanise(F.col("name")).alias("label"))


@query("u6_identity", f"WITH {PX} SELECT dataset_id AS source_id, {r('1', 'value')} FROM dims")
def _(spark, path):
    return registry.standard().run("reference.identity", embedding_images(spark, path)).measurements.select("source_id", "value")


