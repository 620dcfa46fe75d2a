"""Regions of interest in pixel-index space and their membership tests.

A pixel belongs to a region when its centre (x + 0.5, y + 0.5) does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = ("struct<region_id:int,kind:string,left:double,top:double,width:double,height:double,"
          "vertices:array<struct<x:double,y:double>>>")


@dataclass(frozen=True)
class Region:
    region_id: int
    kind: str
    left: float = 0.0
    top: float = 0.0
    width: float = 0.0
    height: float = 0.0
    vertices: tuple[tuple[float, float], ...] = ()


def _finite(*values: float) -> None:
    if not all(math.isfinite(v) for v in values):
        raise ValueError("region coordinates must be finite")


def rectangle(region_id: int, left: float, top: float, width: float, height: float) -> Region:
    _finite(left, top, width, height)
    if width < 0 or height < 0:
        raise ValueError("region size must not be negative")
    return Region(region_id, "Rectangle", left, top, width, height)


def ellipse(region_id: int, left: float, top: float, width: float, height: float) -> Region:
    r = rectangle(region_id, left, top, width, height)
    return Region(region_id, "Ellipse", r.left, r.top, r.width, r.height)


def polygon(region_id: int, vertices: list[tuple[float, float]]) -> Region:
    if len(vertices) < 3:
        raise ValueError("a polygon needs at least three vertices")
    xs, ys = [v[0] for v in vertices], [v[1] for v in vertices]
    _finite(*xs, *ys)
    return Region(region_id, "Polygon", min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys), tuple(vertices))


def region_literal(region: Region) -> Column:
    corners = [F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in region.vertices]
    return F.struct(
        F.lit(region.region_id).alias("region_id"), F.lit(region.kind).alias("kind"),
        F.lit(float(region.left)).alias("left"), F.lit(float(region.top)).alias("top"),
        F.lit(float(region.width)).alias("width"), F.lit(float(region.height)).alias("height"),
        F.array(*corners).alias("vertices"),
    ).cast(REGION)


def in_rectangle(px: Column, py: Column, left, top, width, height) -> Column:
    return (px >= left) & (px < left + width) & (py >= top) & (py < top + height)


def in_ellipse(px: Column, py: Column, left, top, width, height) -> Column:
    rx, ry = width / 2.0, height / 2.0
    solid = (rx > 0) & (ry > 0)
    nx = (px - (left + rx)) / F.when(solid, rx).otherwise(F.lit(1.0))
    ny = (py - (top + ry)) / F.when(solid, ry).otherwise(F.lit(1.0))
    return solid & (nx * nx + ny * ny <= 1.0)


def in_polygon(px: Column, py: Column, vertices: Column) -> Column:
    """Even-odd rule over the edges of a vertex array column."""
    def crosses(a: Column, i: Column) -> Column:
        b = F.element_at(vertices, F.when(i == 0, F.size(vertices)).otherwise(i))
        straddles = (a["y"] > py) != (b["y"] > py)
        rise = F.when(straddles, b["y"] - a["y"]).otherwise(F.lit(1.0))
        return straddles & (px < (b["x"] - a["x"]) * (py - a["y"]) / rise + a["x"])

    hits = F.transform(vertices, lambda a, i: crosses(a, i).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda acc, v: acc + v) % 2 == 1


def contains(region: Column | dict[str, Column], px: Column, py: Column) -> Column:
    """Membership in a region of any kind, given as a struct column or as its fields."""
    box = (region["left"], region["top"], region["width"], region["height"])
    return (F.when(region["kind"] == "Rectangle", in_rectangle(px, py, *box))
            .when(region["kind"] == "Ellipse", in_ellipse(px, py, *box))
            .otherwise(in_polygon(px, py, region["vertices"])))
