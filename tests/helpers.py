"""Small collections built from arrays, and arrays read back from collections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from heightfield.model import CurveSet, ImageSet, axis, channel


def images(spark, *arrays, dx=0.1, dy=0.1, unit="um", y_unit=None) -> ImageSet:
    rows, dims = [], []
    for k, a in enumerate(arrays):
        a = np.asarray(a, dtype=np.float32)
        h, w = a.shape
        y, x = np.mgrid[:h, :w]
        rows.append(pd.DataFrame({"dataset_id": k, "y": y.ravel(), "x": x.ravel(), "z": a.ravel()}))
        dims.append((k, w, h))
    pixels = spark.createDataFrame(_rows(pd.concat(rows)), "dataset_id bigint, y int, x int, z float")
    scans = spark.createDataFrame(dims, "dataset_id bigint, w int, h int").select(
        "dataset_id", F.lit("ScanImage").alias("kind"), axis("X", unit, F.col("w"), step=dx).alias("x"),
        axis("Y", y_unit or unit, F.col("h"), step=dy).alias("y"), channel("z", unit="nm").alias("channel"))
    return ImageSet(scans, pixels=pixels)


def curves(spark, *arrays, dx=0.1, unit="um", origin=0.0) -> CurveSet:
    rows = [pd.DataFrame({"dataset_id": k, "i": np.arange(len(a)), "z": np.asarray(a, dtype=np.float32)}) for k, a in enumerate(arrays)]
    samples = spark.createDataFrame(_rows(pd.concat(rows)), "dataset_id bigint, i int, z float")
    scans = spark.createDataFrame([(k, len(a)) for k, a in enumerate(arrays)], "dataset_id bigint, n int").select(
        "dataset_id", F.lit("LineProfile").alias("kind"), axis("X", unit, F.col("n"), step=dx, origin=origin).alias("x"),
        channel("z", unit="nm").alias("channel"))
    return CurveSet(scans, samples=samples)


def _rows(frame: pd.DataFrame) -> list[tuple]:
    # plain tuples keep NaN as NaN; the pandas path may turn it into NULL
    return [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in frame.itertuples(index=False, name=None)]


def grids(result: ImageSet | object, name=int) -> dict[int, np.ndarray]:
    pixels = result.pixels if isinstance(result, ImageSet) else result
    frame = pixels.toPandas()
    out = {}
    for k, g in frame.groupby("dataset_id"):
        a = np.full((g["y"].max() + 1, g["x"].max() + 1), -999.0, dtype=np.float64)
        a[g["y"], g["x"]] = g["z"]
        assert len(g) == a.size
        out[name(k)] = a
    return out


def lines(result: CurveSet, name=int) -> dict[int, np.ndarray]:
    frame = result.samples.toPandas().sort_values(["dataset_id", "i"])
    return {name(k): g["z"].to_numpy() for k, g in frame.groupby("dataset_id")}
