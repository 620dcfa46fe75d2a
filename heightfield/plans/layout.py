"""Physical plan shapes shared by the operators.

Two rules keep every exchange even when one image or one curve holds a third of all rows:

* per-member values reach the samples by a broadcast only while the catalog is small
  (``BROADCAST_ROWS``); beyond that by a merge join on (dataset_id, block), the member table
  being repeated once per block of its own member, so a giant member spreads over many tasks;
* neighbourhood work is grouped by (dataset_id, block) with a halo, so a group never holds
  more than one block and its margins, whatever the size of the member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heightfield.functions.expr import floordiv, nan
from heightfield.model import BROADCAST_ROWS, CurveSet, ImageSet

TILE = 256       # image block edge, pixels
CHUNK = 65_536   # curve block length, samples
SALTS = 64       # copies of a per-key table where no block is known
BATCH_BYTES = 16 << 20  # bytes handed to a Python worker at once: rows may be whole blocks, lines or files


def bound_batches(df: DataFrame) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES, where the session has no bound of its own: the same bound for every operator, so it
    does not matter which one is planned last."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))


def attach(members: ImageSet | CurveSet, rows: DataFrame, table: DataFrame, *,
           keys: tuple[str, ...] = ("dataset_id",), per_member: int = 1) -> DataFrame:
    """Inner-join a small-per-member ``table`` onto sample-level ``rows``.

    ``per_member`` is the largest number of table rows one member can have under ``keys``.
    """
    keys = list(keys)
    if members.catalog_rows * per_member <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    if isinstance(members, ImageSet):
        blocks = members.geometry().select(
            "dataset_id",
            F.explode(F.sequence(F.lit(0), floordiv(F.col("h") - 1, TILE))).alias("_by"),
            F.col("w").alias("_w"),
        ).select(
            "dataset_id", "_by",
            F.explode(F.sequence(F.lit(0), floordiv(F.col("_w") - 1, TILE))).alias("_bx"),
        )
        salted = rows.withColumns({"_by": floordiv(F.col("y"), TILE), "_bx": floordiv(F.col("x"), TILE)})
        on = [*keys, "_by", "_bx"]
    else:
        blocks = members.geometry().select(
            "dataset_id", F.explode(F.sequence(F.lit(0), floordiv(F.col("n") - 1, CHUNK))).alias("_by"))
        salted = rows.withColumn("_by", floordiv(F.col("i"), CHUNK))
        on = [*keys, "_by"]
    spread = table.join(blocks, "dataset_id").hint("merge")
    return salted.join(spread, on).drop("_by", "_bx")


def attach_salted(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], spread_by: Column) -> DataFrame:
    """Join a table of few rows per key onto rows of no known geometry.

    The table is repeated once per salt and rows take a salt from ``spread_by``, so a key with
    a third of the rows is met by SALTS tasks.  Catalyst still broadcasts a small table.
    """
    salted = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_s"]).drop("_s")


def with_geometry(images: ImageSet, **extra: Column) -> DataFrame:
    """Pixels carrying their image's w, h and any further per-image expression of the catalog."""
    return attach(images, images.pixels, images.geometry(**extra))


def with_curve_geometry(curves: CurveSet, **extra: Column) -> DataFrame:
    return attach(curves, curves.samples, curves.geometry(**extra))


def _block_span(index: Column, reach, size, count: Column) -> Column:
    """Numbers of all blocks whose core plus margins of ``reach`` contain ``index``."""
    first = F.greatest(F.lit(0), floordiv(index - reach, size))
    last = F.least(floordiv(count - 1, size), floordiv(index + reach, size))
    return F.explode(F.sequence(first, last))


def halo_tiles(pixels: DataFrame, *, reach_y=0, reach_x=0, tile_h=TILE, tile_w=TILE,
               carry: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Pack pixels (with w, h) into one row per tile: core plus margins clipped to the image.

    Output: dataset_id, ty, tx, w, h, carry..., y0, x0 (core origin), ch, cw (core size),
    wy, wx (window origin), wh, ww (window size), p ARRAY<INT> (row-major position in the
    window), z ARRAY<FLOAT> and an array per value column in ``also``.  Each row holds at most (tile + 2 reach)^2 samples.
    """
    bound_batches(pixels)
    c = F.col
    if isinstance(reach_y, int) and isinstance(reach_x, int) and reach_y == reach_x == 0:
        rows = pixels.withColumns({"ty": floordiv(c("y"), tile_h), "tx": floordiv(c("x"), tile_w)})
    else:
        rows = pixels.withColumn("ty", _block_span(c("y"), _i(reach_y), tile_h, c("h")))
        rows = rows.withColumn("tx", _block_span(c("x"), _i(reach_x), tile_w, c("w")))
    wy = F.greatest(F.lit(0), c("ty") * _i(tile_h) - _i(reach_y))
    wx = F.greatest(F.lit(0), c("tx") * _i(tile_w) - _i(reach_x))
    ww = F.least(c("w"), (c("tx") + 1) * _i(tile_w) + _i(reach_x)) - wx
    wh = F.least(c("h"), (c("ty") + 1) * _i(tile_h) + _i(reach_y)) - wy
    packed = rows.groupBy("dataset_id", "ty", "tx", "w", "h", *carry).agg(
        F.collect_list(((c("y") - wy) * ww + (c("x") - wx)).cast("int")).alias("p"),
        F.collect_list(F.coalesce(c("z"), nan().cast("float"))).alias("z"),
        *[F.collect_list(F.coalesce(c(v), nan())).alias(v) for v in also],
    )
    return packed.withColumns({
        "y0": (c("ty") * _i(tile_h)).cast("int"), "x0": (c("tx") * _i(tile_w)).cast("int"),
        "wy": wy.cast("int"), "wx": wx.cast("int"), "wh": wh.cast("int"), "ww": ww.cast("int"),
        "ch": F.least(_i(tile_h), c("h") - c("ty") * _i(tile_h)).cast("int"),
        "cw": F.least(_i(tile_w), c("w") - c("tx") * _i(tile_w)).cast("int"),
    })


def tile_pixels(tiles: DataFrame, values: str, *keep: str) -> DataFrame:
    """Back from one row per tile (row-major core array in ``values``) to one row per pixel."""
    return tiles.select("dataset_id", "y0", "x0", "cw", *keep, F.posexplode(values).alias("_p", "z")).select(
        "dataset_id",
        (F.col("y0") + floordiv(F.col("_p"), F.col("cw"))).alias("y"),
        (F.col("x0") + F.col("_p") % F.col("cw")).alias("x"),
        _filled(), *keep,
    )


def halo_chunks(samples: DataFrame, *, reach=0, size=CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pack samples (with n) into one row per chunk of a curve: core plus margins clipped to the curve.

    Output: dataset_id, c, n, carry..., i0 (core start), cn (core length), a (window start),
    wn (window length), p ARRAY<INT> (position in the window), z ARRAY<FLOAT>.
    """
    bound_batches(samples)
    k = F.col
    rows = samples.withColumn("c", _block_span(k("i"), _i(reach), size, k("n")))
    a = F.greatest(F.lit(0), k("c") * _i(size) - _i(reach))
    packed = rows.groupBy("dataset_id", "c", "n", *carry).agg(
        F.collect_list((k("i") - a).cast("int")).alias("p"),
        F.collect_list(F.coalesce(k("z"), nan().cast("float"))).alias("z"),
    )
    return packed.withColumns({
        "i0": (k("c") * _i(size)).cast("int"), "a": a.cast("int"),
        "cn": F.least(_i(size), k("n") - k("c") * _i(size)).cast("int"),
        "wn": (F.least(k("n"), (k("c") + 1) * _i(size) + _i(reach)) - a).cast("int"),
    })


def chunk_samples(chunks: DataFrame, values: str, *keep: str) -> DataFrame:
    """Back from one row per chunk (core array in ``values``) to one row per sample."""
    return chunks.select("dataset_id", "i0", *keep, F.posexplode(values).alias("_p", "z")).select(
        "dataset_id", (F.col("i0") + F.col("_p")).alias("i"), _filled(), *keep)


def _filled() -> Column:
    """Samples are never NULL, but a NaN inside an array can come back from Arrow as one."""
    return F.coalesce(F.col("z"), nan().cast("float")).alias("z")


def _i(value):
    return value if isinstance(value, Column) else F.lit(value)
