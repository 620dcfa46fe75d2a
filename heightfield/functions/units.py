"""Unit registry and affine conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "symbol string, dimension string, scale double, `offset` double"

# base = value * scale + offset.
UNITS = [
    ("m", "Length", 1.0, 0.0), ("mm", "Length", 1e-3, 0.0), ("um", "Length", 1e-6, 0.0),
    ("nm", "Length", 1e-9, 0.0), ("pm", "Length", 1e-12, 0.0), ("Å", "Length", 1e-10, 0.0),
    ("N", "Force", 1.0, 0.0), ("mN", "Force", 1e-3, 0.0), ("uN", "Force", 1e-6, 0.0),
    ("nN", "Force", 1e-9, 0.0), ("pN", "Force", 1e-12, 0.0),
    ("A", "Current", 1.0, 0.0), ("mA", "Current", 1e-3, 0.0), ("uA", "Current", 1e-6, 0.0),
    ("nA", "Current", 1e-9, 0.0), ("pA", "Current", 1e-12, 0.0),
    ("V", "Voltage", 1.0, 0.0), ("mV", "Voltage", 1e-3, 0.0), ("uV", "Voltage", 1e-6, 0.0), ("kV", "Voltage", 1e3, 0.0),
    ("Hz", "Frequency", 1.0, 0.0), ("kHz", "Frequency", 1e3, 0.0), ("MHz", "Frequency", 1e6, 0.0),
    ("Pa", "Pressure", 1.0, 0.0), ("kPa", "Pressure", 1e3, 0.0), ("MPa", "Pressure", 1e6, 0.0), ("GPa", "Pressure", 1e9, 0.0),
    ("N/m", "Stiffness", 1.0, 0.0),
    ("1/m", "WaveNumber", 1.0, 0.0), ("1/cm", "WaveNumber", 100.0, 0.0),
    ("F", "Capacitance", 1.0, 0.0), ("uF", "Capacitance", 1e-6, 0.0), ("nF", "Capacitance", 1e-9, 0.0), ("pF", "Capacitance", 1e-12, 0.0),
    ("K", "Temperature", 1.0, 0.0), ("degC", "Temperature", 1.0, 273.15),
    ("1", "Dimensionless", 1.0, 0.0),
]
_BY_SYMBOL = {u[0]: u for u in UNITS}

# Channel kind implied by a unit's dimension.
KIND_OF_DIMENSION = {
    "Length": "Topography", "Current": "Current", "Voltage": "Voltage", "Force": "Force", "Frequency": "Frequency",
}


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, SCHEMA)


def _registry(extra: list[tuple] | None) -> Column:
    # one literal map in one expression, folded by Catalyst: built column by column it costs a call to the JVM per entry
    pairs = ", ".join(f"'{u[0]}', named_struct('dimension', '{u[1]}', 'scale', {u[2]!r}D, 'offset', {u[3]!r}D)" for u in UNITS + list(extra or []))
    return F.expr(f"map({pairs})")


# Units that operations compose: a product, a product with a squared first factor, and the inverse of a length.
_PRODUCT, _INVERSE = "^(.+?)(²?)·(.+)$", "^1/(.+)$"


def unit_of(symbol: Column, extra=None) -> Column:
    """struct(dimension, scale, offset) of a unit, also of a composed one; NULL for an unknown symbol.

    A symbol is taken apart only where the registry does not have it as it is.
    """
    known = _registry(extra)
    a, b, of = known[F.regexp_extract(symbol, _PRODUCT, 1)], known[F.regexp_extract(symbol, _PRODUCT, 3)], known[F.regexp_extract(symbol, _INVERSE, 1)]
    squared = F.regexp_extract(symbol, _PRODUCT, 2) == "²"

    def unit(dimension, scale):
        return F.struct(dimension.alias("dimension"), scale.alias("scale"), F.lit(0.0).alias("offset"))

    product = unit(F.concat(a["dimension"], F.when(squared, "^2*").otherwise("*"), b["dimension"]), F.when(squared, a["scale"] * a["scale"]).otherwise(a["scale"]) * b["scale"])
    composed = F.when(a.isNotNull() & b.isNotNull(), product).when(of["dimension"] == "Length", unit(F.lit("WaveNumber"), 1.0 / of["scale"]))
    return F.coalesce(known[symbol], composed)


def scale_of(symbol: Column, extra=None) -> Column:
    """Scale to the base unit; NULL for an unknown symbol."""
    return unit_of(symbol, extra)["scale"]


def dimension_of(symbol: Column, extra=None) -> Column:
    return unit_of(symbol, extra)["dimension"]


def is_length(symbol: Column) -> Column:
    return F.coalesce(_registry(None)[symbol]["dimension"] == "Length", F.lit(False))  # no composed unit is a length


def convert(value: Column, source: Column, target: Column, extra=None) -> Column:
    """struct(value, error): the converted value, or NULL with a reason for unknown or unlike units."""
    s, t = unit_of(source, extra), unit_of(target, extra)
    sd, td = s["dimension"], t["dimension"]
    ok = sd == td
    converted = (value * s["scale"] + s["offset"] - t["offset"]) / t["scale"]
    error = (F.when(sd.isNull() | td.isNull(), F.lit("unknown unit"))
             .when(~ok, F.concat(F.lit("cannot convert "), sd, F.lit(" to "), td)))
    return F.struct(F.when(ok, converted).alias("value"), error.alias("error"))


def product_unit(a: str, b: str) -> tuple[str, str, float, float]:
    """Registry row of the unit ``a·b`` (area under a curve)."""
    ua, ub = _BY_SYMBOL[a], _BY_SYMBOL[b]
    return (f"{a}·{b}", f"{ua[1]}*{ub[1]}", ua[2] * ub[2], 0.0)


def psd_unit(z: str, x: str) -> tuple[str, str, float, float]:
    """Registry row of the spectral density unit ``z²·x``."""
    uz, ux = _BY_SYMBOL[z], _BY_SYMBOL[x]
    return (f"{z}²·{x}", f"{uz[1]}^2*{ux[1]}", uz[2] ** 2 * ux[2], 0.0)


def inverse_unit(x: str) -> tuple[str, str, float, float]:
    """Registry row of the spatial frequency unit ``1/x``."""
    ux = _BY_SYMBOL[x]
    return (f"1/{x}", "WaveNumber", 1.0 / ux[2], 0.0)
