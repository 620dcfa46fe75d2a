"""Collections of images and curves as Spark tables.

``ImageSet.pixels``  (dataset_id, y INT, x INT, z FLOAT)
``CurveSet.samples`` (dataset_id, i INT, z FLOAT)
``scans``            (dataset_id, kind, x AXIS, [y AXIS,] channel CHANNEL, ...)   one row per member

Missing samples are NaN, never NULL.  ``dataset_id`` may be any type with equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS = "struct<name:string,unit:string,origin:double,step:double,count:int,direction:string>"
CHANNEL = "struct<key:string,kind:string,unit:string,display_name:string>"

# The channel kinds of the data model.
CHANNEL_KINDS = (
    "Unknown", "Topography", "Deflection", "Amplitude", "Phase", "Frequency", "Current",
    "Voltage", "Force", "Adhesion", "Modulus", "Stiffness", "Intensity",
)

# A per-member table is broadcast only when the catalog holds at most this many rows.
BROADCAST_ROWS = 100_000


def axis(name: str, unit: str, count: Column, origin=0.0, step=1.0, direction="Forward") -> Column:
    """Build an axis struct; every argument may be a value or a column."""
    def c(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        c(name).alias("name"), c(unit).alias("unit"), c(origin).cast("double").alias("origin"),
        c(step).cast("double").alias("step"), c(count).cast("int").alias("count"),
        c(direction).alias("direction"),
    ).cast(AXIS)


def channel(key: str, kind: str = "Topography", unit: str = "um", display_name=None) -> Column:
    if kind not in CHANNEL_KINDS:
        raise ValueError(f"unknown channel kind {kind!r}")
    return F.struct(
        F.lit(key).alias("key"), F.lit(kind).alias("kind"), F.lit(unit).alias("unit"),
        F.lit(display_name or key).alias("display_name"),
    ).cast(CHANNEL)


def reason(rules: list[tuple[Column, str, str]]) -> Column:
    """struct(code, message) of the first rule (condition, code, message) that rejects a catalog row; NULL where none does."""
    told = [F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))) for bad, code, message in rules]
    return F.coalesce(*told) if told else F.lit(None).cast("struct<code:string,message:string>")


def fitting(scans: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Catalog rows that no rule rejects."""
    return scans.filter(reason(rules).isNull())


def rejected(scans: DataFrame, rules: list[tuple[Column, str, str]], key: str = "dataset_id") -> DataFrame:
    """(key, code, message) of every catalog row that a rule rejects."""
    return scans.select(key, reason(rules).alias("r")).filter("r is not null").select(key, "r.*")


@dataclass(frozen=True)
class _Members:
    scans: DataFrame
    known_rows: int | None = field(default=None, kw_only=True)

    @cached_property
    def _facts(self):
        """One small job over the catalog: members and their largest extents."""
        y = "y.count" if "y" in self.scans.columns else "x.count"
        return self.scans.agg(
            F.count(F.lit(1)), F.max("x.count"), F.max(F.greatest("x.count", y)),
            F.max(F.col("x.count").cast("long") * F.col(y))).first()

    @cached_property
    def catalog_rows(self) -> int:
        """Number of members (an upper bound where a derived collection inherited it)."""
        return self._facts[0] if self.known_rows is None else self.known_rows

    @property
    def rows_if_known(self) -> int | None:
        """Upper bound on the members, without running a job; handed to collections derived from this one."""
        return self.__dict__.get("catalog_rows", self.known_rows)

    @property
    def small_catalog(self) -> bool:
        return self.catalog_rows <= BROADCAST_ROWS

    @property
    def spark(self):
        return self.scans.sparkSession


@dataclass(frozen=True)
class ImageSet(_Members):
    """Images as pixels; ``lines`` holds the same samples packed by scan line where the source delivers whole lines."""

    pixels: DataFrame = field(kw_only=True)
    lines: DataFrame | None = field(default=None, kw_only=True)

    def geometry(self, **extra: Column) -> DataFrame:
        """(dataset_id, w, h, ...) with one row per image."""
        return self.scans.select(
            "dataset_id", F.col("x.count").alias("w"), F.col("y.count").alias("h"),
            *[c.alias(k) for k, c in extra.items()],
        )

    @property
    def widest(self) -> int:
        """Largest extent along either axis."""
        return self._facts[2] or 0

    @property
    def largest(self) -> int:
        """Largest pixel count of one image."""
        return self._facts[3] or 0

    def with_pixels(self, pixels: DataFrame, scans: DataFrame | None = None, lines: DataFrame | None = None) -> "ImageSet":
        """Same members (or a rewritten catalog of them) over other pixels, and their lines where they are at hand."""
        return ImageSet(scans if scans is not None else self.scans, pixels=pixels, lines=lines, known_rows=self.rows_if_known)

    def among(self, scans: DataFrame) -> "ImageSet":
        """The images of a smaller catalog; samples of others stay in the tables and drop out where the catalog is joined."""
        return self.with_pixels(self.pixels, scans, self.lines)


@dataclass(frozen=True)
class CurveSet(_Members):
    samples: DataFrame = field(kw_only=True)

    def geometry(self, **extra: Column) -> DataFrame:
        """(dataset_id, n, dx, ...) with one row per curve."""
        return self.scans.select(
            "dataset_id", F.col("x.count").alias("n"), F.abs(F.col("x.step")).alias("dx"),
            *[c.alias(k) for k, c in extra.items()],
        )

    @property
    def longest(self) -> int:
        """Largest sample count in the catalog; decides between whole-curve and chunked plans."""
        return self._facts[1] or 0

    def with_samples(self, samples: DataFrame, scans: DataFrame | None = None) -> "CurveSet":
        return CurveSet(scans if scans is not None else self.scans, samples=samples, known_rows=self.rows_if_known)


__all__ = ["AXIS", "CHANNEL", "BROADCAST_ROWS", "CHANNEL_KINDS", "CurveSet", "ImageSet", "axis", "channel"]
