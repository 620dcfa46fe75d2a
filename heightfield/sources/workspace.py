"""Saved workspaces: versioned Parquet tables published by an append-only manifest."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heightfield.functions.expr import floordiv
from heightfield.functions.units import dimension_of
from heightfield.model import CHANNEL_KINDS, ImageSet
from heightfield.operators.lineage import cycles

SCHEMA_VERSION = "1.0.0"
MANIFEST = "version string, schema_version string, saved_at bigint, active_id string, comparison array<string>"
LINES_PER_BLOCK = 1024


class WorkspaceError(Exception):
    """``kind`` is Io, NotAWorkspace, UnsupportedSchemaVersion or Corrupt."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Workspace:
    images: ImageSet
    steps: DataFrame | None = None
    active_id: str | None = None
    comparison: tuple[str, ...] = ()


def save(workspace: Workspace, root: str) -> str:
    """Write a complete new version, then publish it by one appended manifest row.

    Readers see the previous version until that append commits.  Pixels are laid out by
    (dataset, line block) and sorted, so Parquet statistics prune by dataset and rows.  What is written is summed up once per dataset
    (number and positions of its pixels), so that opening need not read pixels.
    """
    images = workspace.images
    spark = images.spark
    if images.scans.filter("kind <> 'ScanImage'").head(1):
        raise ValueError("only scan images can be saved")
    if images.scans.groupBy("dataset_id").count().filter("count > 1").head(1):
        raise ValueError("a dataset id occurs twice")
    if "parent_id" in images.scans.columns and cycles(images.scans.select("dataset_id", "parent_id")).head(1):
        raise ValueError("the lineage of the datasets has a cycle")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    base = f"{root}/versions/{version}"
    images.scans.write.parquet(f"{base}/scans")
    (images.pixels.select("dataset_id", "y", "x", "z")
     .repartition("dataset_id", floordiv(F.col("y"), LINES_PER_BLOCK))
     .sortWithinPartitions("dataset_id", "y", "x").write.parquet(f"{base}/pixels"))
    positions(spark.read.parquet(f"{base}/pixels")).write.parquet(f"{base}/positions")
    if workspace.steps is not None:
        workspace.steps.write.parquet(f"{base}/steps")
    row = [(version, SCHEMA_VERSION, time.time_ns(), workspace.active_id, list(workspace.comparison))]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


def whole(name: str) -> Column:
    return F.col(name).cast("decimal(18,0)")


def _moments(x: Column, y: Column) -> dict[str, Column]:
    return {"sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}


def positions(pixels: DataFrame) -> DataFrame:
    """Per dataset the number of pixels, their extent, and the sums of their positions."""
    return pixels.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        *[F.sum(v.cast("decimal(28,0)")).cast("decimal(38,0)").alias(n) for n, v in _moments(whole("x"), whole("y")).items()])


def problems(images: ImageSet, active_id: str | None, comparison: tuple[str, ...], counted: DataFrame | None = None) -> DataFrame:
    """Integrity violations as (dataset_id STRING, problem); empty for a sound workspace.

    ``counted`` holds the :func:`positions` where they are known; otherwise all pixels are read.
    """
    c = F.col
    ident = c("dataset_id").cast("string").alias("dataset_id")
    counted = positions(images.pixels) if counted is None else counted
    full = images.geometry().join(counted, "dataset_id", "full_outer")
    exact = ((c("n") == c("w").cast("long") * c("h")) & (c("x0") == 0) & (c("y0") == 0)
             & (c("x1") == c("w") - 1) & (c("y1") == c("h") - 1))
    # a pixel written twice in place of another leaves the count but not the sums of the positions
    w, h = whole("w"), whole("h")
    line, square = lambda n: n * (n - 1), lambda n: n * (n - 1) * (2 * n - 1)
    for name, factor, closed in (("sx", 2, line(w) * h), ("sy", 2, line(h) * w), ("sxx", 6, square(w) * h), ("syy", 6, square(h) * w), ("sxy", 4, line(w) * line(h))):
        exact = exact & (c(name) * factor == closed)
    checks = [
        full.filter(c("w").isNotNull() & ~F.coalesce(exact, F.lit(False))).select(ident, F.lit("pixel buffer does not match its axes").alias("problem")),
        full.filter(c("w").isNull()).select(ident, F.lit("pixels without a catalog row").alias("problem")),
    ]

    def bad(condition, text):
        checks.append(images.scans.filter(~F.coalesce(condition, F.lit(False))).select(ident, F.lit(text).alias("problem")))

    for ax in ("x", "y"):
        bad(dimension_of(c(f"{ax}.unit")).isNotNull(), f"unknown {ax} unit")
        bad((c(f"{ax}.step") != 0) & (F.abs(c(f"{ax}.step")) < float("inf")) & (c(f"{ax}.count") >= 0), f"invalid {ax} axis")
        bad(c(f"{ax}.direction").isin("Forward", "Reverse"), f"invalid {ax} direction")
    bad(dimension_of(c("channel.unit")).isNotNull(), "unknown channel unit")
    bad(c("channel.kind").isin(*CHANNEL_KINDS), "invalid channel kind")
    bad(c("kind") == "ScanImage", "unsupported dataset kind")
    checks.append(images.scans.groupBy("dataset_id").count().filter("count > 1").select(ident, F.lit("duplicate dataset id").alias("problem")))
    named = [(i, f"dangling {what} id") for what, ids in (("comparison", comparison), ("active", (active_id,) if active_id else ())) for i in ids]
    if named:
        asked = images.spark.createDataFrame(named, "dataset_id string, problem string")
        checks.append(asked.join(images.scans.select(ident), "dataset_id", "left_anti"))
    return reduce(DataFrame.unionByName, checks)


def open_workspace(spark: SparkSession, root: str) -> Workspace:
    """Latest published version, checked; raises WorkspaceError with a typed kind.

    The check compares the catalog with the positions recorded at saving, and their number with the row counts in the Parquet footers: no
    pixel is read.  :func:`audit` reads them all.
    """
    try:
        manifests = spark.read.schema(MANIFEST).json(f"{root}/manifest")
        latest = manifests.orderBy(F.desc("saved_at")).first()
    except AnalysisException as missing:
        raise WorkspaceError("NotAWorkspace", f"no manifest under {root}") from missing
    except Exception as other:
        raise WorkspaceError("Io", str(other)) from other
    if latest is None or latest["version"] is None:
        raise WorkspaceError("NotAWorkspace", f"no readable manifest under {root}")
    if latest["schema_version"] != SCHEMA_VERSION:
        raise WorkspaceError("UnsupportedSchemaVersion", str(latest["schema_version"]))
    base = f"{root}/versions/{latest['version']}"
    try:
        images = ImageSet(spark.read.parquet(f"{base}/scans"), pixels=spark.read.parquet(f"{base}/pixels"))
    except AnalysisException as missing:
        raise WorkspaceError("Corrupt", f"missing table in version {latest['version']}") from missing
    try:
        steps = spark.read.parquet(f"{base}/steps")
    except AnalysisException:
        steps = None
    opened = Workspace(images, steps, latest["active_id"], tuple(latest["comparison"] or ()))
    try:
        recorded = spark.read.parquet(f"{base}/positions")
    except AnalysisException:  # saved before positions were recorded
        recorded = None
    if recorded is not None:
        rows, expected = images.pixels.count(), recorded.agg(F.sum("n")).first()[0] or 0
        if rows != expected:
            raise WorkspaceError("Corrupt", f"{rows} pixels where {expected} were saved")
    return audit(opened, recorded)


def audit(workspace: Workspace, recorded: DataFrame | None = None) -> Workspace:
    """The workspace, if it is sound; without the positions recorded at saving every pixel is read."""
    found = problems(workspace.images, workspace.active_id, workspace.comparison, recorded).head(1)
    if found:
        raise WorkspaceError("Corrupt", f"{found[0]['dataset_id']}: {found[0]['problem']}")
    return workspace
