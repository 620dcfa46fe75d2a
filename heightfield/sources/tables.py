"""Image and curve collections from the analytic tables (embeddings, events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightfield.functions.expr import floordiv
from heightfield.model import CurveSet, ImageSet, axis, channel

VECTORS_PER_BLOCK = 4096


def ranked(rows: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """Zero-based rank of each row within ``key``, as column ``rank``.

    ``block`` must be monotonic in the order.  Rows are only sorted inside a block; block
    totals give the offsets, so a key holding most of the table is ranked by many tasks.
    """
    rows = rows.withColumn("_b", block)
    seen = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .select(key, "_b", F.coalesce(F.sum("_n").over(seen), F.lit(0)).alias("_off")))
    inner = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    return (rows.withColumn("_r", inner).join(offsets, [key, "_b"])
            .withColumn("rank", (F.col("_off") + F.col("_r") - 1).cast("int")).drop("_b", "_r", "_off"))


def embedding_images(spark: SparkSession, path: str, *, dx: float = 0.1, dy: float = 0.1,
                     unit: str = "um") -> ImageSet:
    """One image per label: a scan line per vector in vec_id order, a pixel per component."""
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    lines = ranked(e.select("vec_id", "label", "embedding"), "label", ["vec_id"],
                   floordiv(F.col("vec_id"), VECTORS_PER_BLOCK))
    lines = lines.select(F.col("label").cast("long").alias("dataset_id"), F.col("rank").alias("y"), F.col("embedding").alias("z"))
    pixels = lines.select("dataset_id", "y", F.posexplode("z").alias("x", "z"))
    scans = (e.groupBy("label").agg(F.count(F.lit(1)).alias("h"), F.max(F.size("embedding")).alias("w"))
             .select(F.col("label").cast("long").alias("dataset_id"), F.lit("ScanImage").alias("kind"),
                     axis("X", unit, F.col("w"), step=dx).alias("x"), axis("Y", unit, F.col("h"), step=dy).alias("y"),
                     channel("height", unit="nm").alias("channel")))
    return ImageSet(scans, pixels=pixels, lines=lines)


def embedding_curves(spark: SparkSession, path: str, *, dx: float = 0.1, unit: str = "um") -> CurveSet:
    """One 64-sample curve per vector."""
    e = spark.read.parquet(f"{path}/embeddings.parquet")
    samples = e.select(F.col("vec_id").alias("dataset_id"), F.posexplode("embedding").alias("i", "z"))
    scans = e.select(F.col("vec_id").alias("dataset_id"), F.lit("LineProfile").alias("kind"),
                     axis("X", unit, F.size("embedding"), step=dx).alias("x"), channel("height", unit="nm").alias("channel"))
    return CurveSet(scans, samples=samples)


def event_curves(spark: SparkSession, path: str, *, dx: float = 0.1, unit: str = "um", gaps: int = 0) -> CurveSet:
    """One curve per user: values in (ts, event_id) order.  ``gaps`` > 0 makes every gaps-th event id a NaN."""
    ev = spark.read.parquet(f"{path}/events.parquet").select("event_id", "ts", "user_id", "value")
    rows = ranked(ev, "user_id", ["ts", "event_id"], F.date_trunc("hour", F.col("ts")))
    z = F.col("value").cast("float")
    if gaps:
        z = F.when(F.col("event_id") % gaps == 0, F.lit(float("nan")).cast("float")).otherwise(z)
    samples = rows.select(F.col("user_id").alias("dataset_id"), F.col("rank").alias("i"), z.alias("z"))
    scans = (ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("user_id").alias("dataset_id"), F.lit("LineProfile").alias("kind"),
                     axis("X", unit, F.col("n"), step=dx).alias("x"), channel("signal", kind="Voltage", unit="V").alias("channel")))
    return CurveSet(scans, samples=samples)
