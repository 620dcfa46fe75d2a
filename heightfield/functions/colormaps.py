"""Named 256-step colour maps as closed-form channel expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 256


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int")


# Each channel is clamp(a * index + b), as (a, b) per channel.
RAMPS = {
    "Gold": ((2.0, 0.0), (2.0, -128.0), (2.0, -256.0)),
    "Grayscale": ((1.0, 0.0), (1.0, 0.0), (1.0, 0.0)),
    "Aqua": ((2.0, -256.0), (2.0, -128.0), (2.0, 0.0)),
    "Brown": ((1.0, 0.0), (1.5, -128.0), (3.0, -512.0)),
    "Melon": ((2.0, -128.0), (2.0, -256 * 0.15), (2.0, -256 * 0.9)),
    "Red": ((2.0, 0.0), (2.0, -256.0), (2.0, -256.0)),
    "Green": ((2.0, -256.0), (2.0, 0.0), (2.0, -256.0)),
}
DEFAULT = "Gold"


def resolve(name: str | None) -> str:
    """Map name ignoring case; the default for an unknown one."""
    return next((n for n in RAMPS if name and n.lower() == name.lower()), DEFAULT)


def colour(level: Column, name: str | None = DEFAULT) -> list[Column]:
    """Red, green and blue of a normalised level; a non-finite level takes the first entry."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), level))
    index = F.when(F.isnan(level), F.lit(0)).otherwise((t * (STEPS - 1)).cast("int"))
    return [_byte(index * a + b).alias(c) for c, (a, b) in zip("rgb", RAMPS[resolve(name)])]
