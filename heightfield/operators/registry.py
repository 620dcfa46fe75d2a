"""Registered operations: descriptors, parameter validation, results and provenance."""

from __future__ import annotations

import datetime
import json
import math
import platform
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heightfield.functions.expr import clamp, finite
from heightfield.functions.regions import Region
from heightfield.functions.units import is_length
from heightfield.model import CurveSet, ImageSet, fitting, rejected
from heightfield.operators import baseline, curve, flatten, gauss, grains, peaks, pixel, profiles, regions, spectral, statistics, stencil
from heightfield.plans.iterate import cut

IMAGE, CURVE = "ScanImage", "LineProfile"
VERSION = "2"


@dataclass(frozen=True)
class Param:
    name: str
    type: type
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


def _of_type(p: Param, v: object) -> bool:
    """Whole numbers pass for real ones; booleans are never numbers."""
    if isinstance(v, bool) or p.type is bool:
        return isinstance(v, bool) and p.type is bool
    return isinstance(v, (int, float)) if p.type is float else isinstance(v, p.type)


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


# What can be wrong with a value: the first rule that holds is reported.
RULES: tuple[tuple[Callable[[Param, object], bool], str], ...] = (
    (lambda p, v: v is None, "no value given"),
    (lambda p, v: bool(p.choices) and v not in p.choices, "{v!r} is not one of its choices"),
    (lambda p, v: not p.choices and not _of_type(p, v), "expected {p.type.__name__}, got {v!r}"),
    (lambda p, v: _number(v) and not math.isfinite(v), "{v} is not a finite number"),
    (lambda p, v: _number(v) and p.low is not None and v < p.low, "{v} is too small, the least is {p.low}"),
    (lambda p, v: _number(v) and p.high is not None and v > p.high, "{v} is too large, the most is {p.high}"),
)


def validate(schema: tuple[Param, ...], values: dict[str, object]) -> list[str]:
    """All complaints about a parameter set, before any plan is built; empty when it is valid."""
    names = {p.name for p in schema}
    told = [f"{name}: not a parameter here" for name in values if name not in names]
    told += [f"{p.name}: required" for p in schema if p.default is None and p.name not in values]
    for p in (p for p in schema if p.name in values):
        v = values[p.name]
        told += [f"{p.name}: " + text.format(p=p, v=v) for holds, text in RULES if holds(p, v)][:1]
    return told


def coerce(schema: tuple[Param, ...], values: dict[str, object]) -> dict[str, object]:
    """Text from forms to typed values; what cannot be converted is left for :func:`validate` to report."""
    out = {}
    for name, v in values.items():
        p = next((q for q in schema if q.name == name), None)
        try:
            if p is not None and p.choices and not isinstance(v, bool):
                if isinstance(v, int) or (isinstance(v, str) and v.isdigit()):
                    v = p.choices[int(v)] if 0 <= int(v) < len(p.choices) else v
                elif isinstance(v, str):
                    v = next((c for c in p.choices if c.lower() == v.lower()), v)
            elif p is not None and isinstance(v, str) and p.type in (int, float):
                v = p.type(v)
            elif p is not None and p.type is float and isinstance(v, int) and not isinstance(v, bool):
                v = float(v)
        except ValueError:
            pass
        out[name] = v
    return out


@dataclass(frozen=True)
class Operation:
    """``run(collection, **params)`` returns a collection, or a wide table of named scalars per dataset."""

    id: str
    accepts: str
    params: tuple[Param, ...]
    run: Callable
    output: str                                   # DerivedDataset or Artifact
    units: dict[str, str] = field(default_factory=dict)  # scalar -> z, x, zx or 1
    applicable: Callable[[], Column] | None = None
    uses_region: bool = False
    category: str = ""
    version: int = 1
    deterministic: bool = True
    extra_errors: Callable[[dict], list[str]] | None = None
    warnings: Callable | None = None              # (data, params, output) -> (dataset_id, code)
    effective: Callable[[dict], dict] | None = None  # parameters that actually took effect, where they differ
    tables: Callable | None = None                # (data, params, shared) -> further result tables by name
    shared: Callable | None = None                # (data, params) -> what ``run`` and ``tables`` are both made from, evaluated once
    rejects: Callable[[dict], list[tuple[Column, str, str]]] | None = None  # params -> (condition, code, message) of members it cannot take


@dataclass(frozen=True)
class Result:
    """Exactly one of ``derived`` and ``measurements``, with diagnostics (code and message) and provenance rows.

    ``rejects`` names the members the operation could not be given to, with the reason; ``tables`` holds what belongs
    beside the scalars: a histogram, a list of peaks.
    """

    derived: ImageSet | CurveSet | None
    measurements: DataFrame | None
    warnings: DataFrame
    steps: DataFrame
    rejects: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self._ops: dict[str, Operation] = {}

    def add(self, op: Operation) -> None:
        if op.id in self._ops:
            raise ValueError(f"operation {op.id!r} is already registered")
        self._ops[op.id] = op

    def get(self, op_id: str) -> Operation:
        return self._ops[op_id]

    def all(self) -> list[Operation]:
        return sorted(self._ops.values(), key=lambda o: (o.category, o.id))

    def for_kind(self, kind: str) -> list[Operation]:
        return [o for o in self.all() if o.accepts == kind]

    def applicable(self, scans: DataFrame) -> DataFrame:
        """(dataset_id, operation_id): operations each catalog row can be given to."""
        rules = [F.when((F.col("kind") == o.accepts) & (o.applicable() if o.applicable else F.lit(True)), F.lit(o.id))
                 for o in self.all()]
        return scans.select("dataset_id", F.explode(F.array_compact(F.array(*rules))).alias("operation_id"))

    def listing(self, scans: DataFrame) -> DataFrame:
        """(dataset_id, position, operation_id, label): the operations for each dataset's kind in the order they are listed."""
        rows = [(kind, n, o.id, o.id.split(".")[-1]) for kind in (IMAGE, CURVE) for n, o in enumerate(self.for_kind(kind))]
        table = scans.sparkSession.createDataFrame(rows, "kind string, position int, operation_id string, label string")
        return scans.select("dataset_id", "kind").join(F.broadcast(table), "kind").select("dataset_id", "position", "operation_id", humanise(F.col("label")).alias("label"))

    def parameters(self, spark) -> DataFrame:
        """(operation_id, parameter, whole, low, high, required): every parameter, choices as codes from 0."""
        rows = [(o.id, p.name, p.type is int or bool(p.choices), 0.0 if p.choices else p.low, float(len(p.choices) - 1) if p.choices else p.high,
                 bool(p.choices), p.default is None) for o in self.all() for p in o.params]
        rows = [(i, n, w, None if lo is None else float(lo), None if hi is None else float(hi), c, r) for i, n, w, lo, hi, c, r in rows]
        return spark.createDataFrame(rows, "operation_id string, parameter string, whole boolean, low double, high double, choice boolean, required boolean")

    def problems(self, sets: DataFrame) -> DataFrame:
        """(set_id, operation_id, parameter, problem) of recorded parameter sets, checked where they lie.

        ``sets`` is (set_id, operation_id, parameter, value DOUBLE), choices by code, as provenance records them.  The rules are those of
        :func:`validate`, the first that holds is told; the registry is a broadcast table of one row per parameter.
        """
        spark, v, c = sets.sparkSession, F.col("value"), F.col
        known = self.parameters(spark).withColumn("known", F.lit(True))
        operations = spark.createDataFrame([(o.id, True) for o in self.all()], "operation_id string, registered boolean")
        rows = sets.join(F.broadcast(operations), "operation_id", "left").join(F.broadcast(known), ["operation_id", "parameter"], "left")
        problem = (F.when(c("registered").isNull(), "unknown operation").when(c("known").isNull(), "unknown parameter").when(v.isNull(), "no value")
                   .when(~finite(v), "not finite").when(c("whole") & (v != F.floor(v)), F.when(c("choice"), "no such choice").otherwise("not a whole number"))
                   .when((v < c("low")) | (v > c("high")), F.when(c("choice"), "no such choice").when(v < c("low"), "too small").otherwise("too large")))
        told = rows.select("set_id", "operation_id", "parameter", problem.alias("problem")).filter("problem is not null")
        needed = known.filter("required").select("operation_id", "parameter")
        missing = sets.select("set_id", "operation_id").distinct().join(F.broadcast(needed), "operation_id").join(
            sets.select("set_id", "operation_id", "parameter"), ["set_id", "operation_id", "parameter"], "left_anti")
        return told.unionByName(missing.select("set_id", "operation_id", "parameter", F.lit("required").alias("problem")))

    def enum_codes(self, spark) -> DataFrame:
        """(operation_id, operation_version, parameter, code, label) of every choice parameter."""
        rows = [(o.id, o.version, p.name, float(k), c) for o in self.all() for p in o.params for k, c in enumerate(p.choices)]
        return spark.createDataFrame(
            rows, "operation_id string, operation_version int, parameter string, code double, label string")

    def run(self, op_id: str, data: ImageSet | CurveSet, values: dict[str, object] | None = None,
            areas: list[Region] | None = None) -> Result:
        """Validate, then plan the operation on every applicable member; ``areas`` restricts region-capable ones."""
        op = self.get(op_id)
        values = coerce(op.params, dict(values or {}))
        errors = validate(op.params, values)
        params = {p.name: p.default for p in op.params} | values
        if not errors and op.extra_errors:
            errors = op.extra_errors(params)
        if (op.accepts == IMAGE) != isinstance(data, ImageSet):
            errors.append(f"it works on members of kind {op.accepts}, these are of another kind")
        if areas and not op.uses_region:
            errors.append("it cannot be restricted to regions")
        if errors:
            raise ValueError(f"cannot run {op.id!r}: " + "; ".join(errors))
        rules = op.rejects(params) if op.rejects else []
        if op.applicable:
            rules = [*rules, (~F.coalesce(op.applicable(), F.lit(False)), "not-applicable", "the operation does not apply to this dataset")]
        refused = rejected(data.scans, rules).select("dataset_id", F.lit(op.id).alias("operation_id"), "code", "message")
        if rules:
            fit = fitting(data.scans, rules)
            data = data.among(fit) if isinstance(data, ImageSet) else data.with_samples(data.samples, fit)
        started, clock = datetime.datetime.now(datetime.timezone.utc), time.monotonic()
        told = params | ({"regions": areas} if areas else {})
        shared = cut(op.shared(data, params)) if op.shared else None
        out = op.run(data, **told) if shared is None else op.run(data, **told, shared=shared)
        empty = data.scans.select("dataset_id", F.lit("").alias("code")).limit(0)
        measured = op.output != "DerivedDataset"
        if measured:
            out = cut(out)  # a row per member: measurements, warnings and steps read it instead of running the operation again
        warnings = (op.warnings(data, told, out) if op.warnings else empty).withColumn("message", _messages()[F.col("code")])
        if measured:
            warnings = cut(warnings)
        took = time.monotonic() - clock if measured else None
        steps = provenance_steps(op, data.scans, params, warnings, areas, started, took)
        if not measured:
            return Result(_identified(op, out, params), None, warnings, steps, refused)
        return Result(None, measurements(op, data, out, params, areas), warnings, steps, refused, op.tables(data, params, shared) if op.tables else {})


def artifact_id(op: Operation, params: dict, region: Column | None = None) -> Column:
    """Stable identity of a result: the same input, operation, parameters and region give the same id."""
    text = json.dumps([op.id, op.version, params], sort_keys=True, default=str)
    parts = [F.col("dataset_id").cast("string"), F.lit(text)] + ([] if region is None else [region.cast("string")])
    return F.sha2(F.concat_ws("|", *parts), 256)


def _identified(op: Operation, out: ImageSet | CurveSet, params: dict) -> ImageSet | CurveSet:
    """A result under its own id, with the input as parent; the id is a function of the old one, so no row is joined."""
    name = artifact_id(op, params)
    scans = out.scans.withColumns({"parent_id": F.col("dataset_id").cast("string"), "dataset_id": name})
    if isinstance(out, ImageSet):
        return out.with_pixels(out.pixels.withColumn("dataset_id", name), scans)
    return out.with_samples(out.samples.withColumn("dataset_id", name), scans)


# Recorded codes of the region kinds.
REGION_CODES = {"Rectangle": 0, "Ellipse": 1, "Polygon": 2}


def region_parameters(region: Region) -> dict[str, float]:
    """What identifies a region in provenance: shape, bounds and, for a polygon, its vertices."""
    out = {"regionShape": REGION_CODES[region.kind], "regionLeft": region.left, "regionTop": region.top,
           "regionWidth": region.width, "regionHeight": region.height}
    if region.vertices:
        out["regionVertexCount"] = len(region.vertices)
        for k, (x, y) in enumerate(region.vertices):
            out |= {f"regionX{k}": x, f"regionY{k}": y}
    return out


# Units of parameters: of the channel (z) or of the X axis (x); the others have none.
PARAMETER_UNITS = {("image.pixelmath", "amount"): "z", ("image.roughness-filtered", "cutoff"): "x", ("profile.roughness-filtered", "cutoff"): "x",
                   ("profile.filter", "cutoff"): "x", ("curve.peaks", "minWidth"): "x"}


def parameter_units(op: Operation) -> Column:
    """Map of each parameter to its unit, ``1`` where it has none."""
    unit = {"z": F.col("channel.unit"), "x": F.col("x.unit"), "1": F.lit("1")}
    pairs = [x for p in op.params for x in (F.lit(p.name), unit[PARAMETER_UNITS.get((op.id, p.name), "1")])]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


DIAGNOSTIC = "array<struct<code:string,message:string>>"


def provenance_steps(op: Operation, scans: DataFrame, params: dict, warnings: DataFrame, areas: list[Region] | None = None,
                     started: datetime.datetime | None = None, took: float | None = None) -> DataFrame:
    """One step per input dataset (and region): what ran when, where and for how long, with which effective parameters, and its diagnostics.

    Choices are recorded by code; values an input clamps are recorded as clamped for that input.  A step has an id of its own per run;
    the time is that of the run, whenever the table is read; the duration is null for a derived dataset, which is lazy.
    """
    started = started or datetime.datetime.now(datetime.timezone.utc)
    spark, run = scans.sparkSession, uuid.uuid4().hex
    environment = {"library": VERSION, "spark": spark.version, "python": platform.python_version(), "system": platform.system()}
    used = params | (op.effective(params) if op.effective else {})
    choices = {p.name: p.choices for p in op.params if p.choices}
    coded = {k: float(choices[k].index(v)) if k in choices else v for k, v in used.items()}

    def table(extra: dict) -> Column:
        pairs = [x for k, v in (coded | extra).items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(float(v))).cast("double"))]
        return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,double>)")

    keys = ["dataset_id", "region_id"] if areas else ["dataset_id"]
    told = warnings.groupBy(*keys).agg(F.sort_array(F.collect_set("code")).alias("warnings"), F.sort_array(F.collect_set(F.struct("code", "message"))).alias("details"))
    rows, region, parameters = scans, None, table({})
    if areas:
        one = F.explode(F.array(*[F.struct(F.lit(r.region_id).alias("region_id"), table(region_parameters(r)).alias("parameters")) for r in areas]))
        rows = scans.withColumn("_r", one).withColumn("region_id", F.col("_r.region_id"))
        region, parameters = F.col("region_id"), F.col("_r.parameters")
    rows = rows.join(told, keys, "left")
    made = artifact_id(op, params, region)
    return rows.select(
        F.sha2(F.concat_ws("|", made, F.lit(run)), 256).alias("step_id"), made.alias("artifact_id"), F.col("dataset_id").alias("input_dataset_id"), F.lit(0).alias("input_version"),
        F.lit(op.id).alias("operation_id"), F.lit(op.version).alias("operation_version"), F.lit(0).alias("step_order"),
        parameters.alias("parameters"), parameter_units(op).alias("parameter_units"), F.lit(VERSION).alias("library_version"),
        F.lit(started).alias("ran_at"), F.lit(took).cast("double").alias("seconds"), F.create_map(*[F.lit(x) for kv in environment.items() for x in kv]).alias("environment"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.coalesce("details", F.array().cast(DIAGNOSTIC)).alias("warning_details"),
        F.array().cast(DIAGNOSTIC).alias("errors"))


def measurements(op: Operation, data, wide: DataFrame, params: dict, areas: list[Region] | None = None) -> DataFrame:
    """Long form of a scalar table: (artifact_id, source_id, operation_id, [region_id,] name, value, unit)."""
    names = [c for c in wide.columns if c in op.units]
    keys = ["region_id"] if areas else []
    unit = {"z": F.col("channel.unit"), "x": F.col("x.unit"), "1": F.lit("1"),
            "zx": F.concat_ws("·", F.col("channel.unit"), F.col("x.unit"))}
    rows = wide.join(data.scans.select("dataset_id", "x", "channel"), "dataset_id").select(
        "dataset_id", *keys, artifact_id(op, params, F.col("region_id") if areas else None).alias("artifact_id"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), unit[op.units[n]].alias("unit"))
                            for n in names])).alias("m"))
    return rows.select("artifact_id", F.col("dataset_id").alias("source_id"), F.lit(op.id).alias("operation_id"), *keys, "m.*")


def _length_x() -> Column:
    return is_length(F.col("x.unit"))


def _lengths() -> Column:
    return is_length(F.col("x.unit")) & is_length(F.col("y.unit"))


def _one_line(images: ImageSet, x0, y0, x1, y1, samples) -> CurveSet:
    lines = images.scans.select(F.col("dataset_id").alias("line_id"), "dataset_id", *[
        F.lit(float(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], F.lit(samples).alias("samples"))
    return profiles.line_profiles(images, lines)


def _roughness(images: ImageSet, **given) -> DataFrame:
    areas = given.get("regions")
    return regions.region_roughness(images, areas) if areas else statistics.areal_roughness(images)


def _statistics(images: ImageSet, binCount: int) -> DataFrame:
    long = statistics.image_statistics(images)
    return long.groupBy("dataset_id").pivot("name", list(statistics.STATISTICS)).agg(F.first("value"))


def _gaps(rows: DataFrame, code: str) -> DataFrame:
    """(dataset_id, code) of members with a non-finite sample among ``rows``."""
    bad = F.max((~finite(F.col("z"))).cast("int")) == 1
    return rows.groupBy("dataset_id").agg(bad.alias("bad")).filter("bad").select("dataset_id", F.lit(code).alias("code"))


def _non_finite(code: str) -> Callable:
    return lambda data, params, out: _gaps(data.pixels if isinstance(data, ImageSet) else data.samples, code)


def _flagged(out: DataFrame, condition: Column, code: str) -> DataFrame:
    return out.filter(condition).select("dataset_id", F.lit(code).alias("code")).distinct()


def _statistics_warnings(data: ImageSet, params: dict, out: DataFrame) -> DataFrame:
    spread = data.pixels.groupBy("dataset_id").agg(
        F.min(F.when(finite(F.col("z")), F.col("z"))).alias("lo"), F.max(F.when(finite(F.col("z")), F.col("z"))).alias("hi"))
    flat = spread.filter(~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)))
    return _gaps(data.pixels, "statistics.non-finite").unionByName(flat.select("dataset_id", F.lit("statistics.degenerate-range").alias("code")))


def _region_warnings(gap: str, none: str) -> Callable:
    """Per image, or per image and region: the region decides which pixels count."""
    def rows(data: ImageSet, params: dict, out: DataFrame) -> DataFrame:
        if not params.get("regions"):
            return _gaps(data.pixels, gap)
        counted = out.join(regions.mask_counts(data, params["regions"]), ["dataset_id", "region_id"])
        code = F.when(F.col("n") == 0, F.lit(none)).when(~finite(F.col("Sq")), F.lit(gap))
        return counted.select("dataset_id", "region_id", code.alias("code")).filter("code is not null")

    return rows


def _roi_warnings(data: ImageSet, p: dict, out: DataFrame) -> DataFrame:
    # finite pixels are counted in the result, those of the region in one aggregate
    both = out.join(regions.roi_pixels(data, **p), "dataset_id")
    return _flagged(both, F.col("PixelCount") < F.col("pixels"), "roi.non-finite").unionByName(_flagged(both, F.col("PixelCount") == 0, "roi.empty"))


def _range_warnings(data: CurveSet, p: dict, out: DataFrame) -> DataFrame:
    i = F.col("i")
    told = _gaps(data.samples.filter((i >= p["start"]) & (i < p["start"] + p["count"])), "range-statistics.non-finite")
    return told.unionByName(_flagged(out, F.isnan("RangeMin"), "range-statistics.empty"))


def _filtered_curve_warnings(data: CurveSet, p: dict, out: DataFrame) -> DataFrame:
    told = _gaps(data.samples, "filtered-roughness.non-finite")
    return told.unionByName(_flagged(out, F.col("SamplingLengths") < gauss.SAMPLING_LENGTHS, "filtered-roughness.short"))


def _clamped_box(p: dict) -> dict:
    return {"width": F.least(F.lit(p["width"]), F.col("x.count") - p["left"]), "height": F.least(F.lit(p["height"]), F.col("y.count") - p["top"])}


def _clamped_count(p: dict) -> dict:
    return {"count": F.least(F.lit(p["count"]), F.col("x.count") - p["start"])}


def _clamped_line(p: dict) -> dict:
    return {n: clamp(F.lit(p[n]), 0.0, (F.col(f"{n[0]}.count") - 1).cast("double")) for n in ("x0", "y0", "x1", "y1")}


def _band_cutoffs(p: dict) -> dict:
    return ({"lowCutoff": 0.0} if p["kind"] == "LowPass" else {}) | ({"highCutoff": 1.0} if p["kind"] == "HighPass" else {})


def _cutoffs(p: dict) -> list[str]:
    if p["kind"] in ("BandPass", "BandStop") and not p["lowCutoff"] < p["highCutoff"]:
        return ["lowCutoff: not below highCutoff"]
    return []


def _odd_size(p: dict) -> list[str]:
    if p["kind"] in stencil.SIZED and p["size"] not in (3, 5, 7, 9):
        return ["size: a kernel has an odd edge from 3 to 9"]
    return []


def _window(p: dict) -> list[str]:
    errors = [] if p["window"] % 2 else ["window: an even number has no middle sample"]
    return errors + ([] if p["order"] < p["window"] else ["order: needs a window with more samples"])


def _positive_cutoff(p: dict) -> list[str]:
    return [] if p["cutoff"] > 0 else ["cutoff: a wavelength is above zero"]


def _origin(axes: tuple[tuple[str, str], ...]) -> Callable[[dict], list]:
    """Rejects members that do not reach a start given by (axis, parameter)."""
    return lambda p: [(F.col(f"{ax}.count") <= p[name], "origin.outside", "the start lies outside the data") for ax, name in axes]


def _no_line(p: dict) -> list:
    ends = _clamped_line(p)
    return [(~_lengths(), *gauss.NOT_LENGTH), ((ends["x0"] == ends["x1"]) & (ends["y0"] == ends["y1"]), "line.no-length", "the line has no length inside the image")]


# What each warning code says.
MESSAGES = {
    "statistics.non-finite": "samples that are not finite make the values NaN", "statistics.degenerate-range": "all finite samples are equal, so the histogram is empty",
    "roughness.non-finite": "samples that are not finite make the parameters NaN", "roughness.empty-region": "the region covers no pixel of the image",
    "filtered-roughness.non-finite": "samples that are not finite were met by the filter", "filtered-roughness.empty-region": "the region covers no pixel of the image",
    "filtered-roughness.short": "the curve holds fewer than five sampling lengths", "roi.non-finite": "pixels of the region that are not finite were left out",
    "roi.empty": "the region holds no finite pixel", "grains.non-finite": "pixels that are not finite belong to no grain",
    "flatten.underdetermined": "too few samples for the order: returned as given", "psd.skipped-lines": "lines with samples that are not finite were left out",
    "psd.empty": "no line is finite throughout: the spectrum is zero", "profile-roughness.non-finite": "samples that are not finite were left out",
    "profile-roughness.empty": "no sample is finite", "range-statistics.non-finite": "samples of the range that are not finite were left out",
    "range-statistics.empty": "the range holds no finite sample", "peaks.none": "no peak is left by prominence, signal-to-noise ratio and width",
    "profile-flatten.non-finite": "samples that are not finite took no part in the fit", "profile-flatten.low-rank": "too few finite samples for the order: returned as given",
    "profile-flatten.singular": "the fit has no solution: returned as given", "profile-smooth.non-finite": "samples that are not finite took no part in the local fits",
    "profile-baseline.non-finite": "samples that are not finite took no part in the baseline", "profile-baseline.low-rank": "fewer than three finite samples: returned as given",
    "profile-baseline.singular": "the baseline has no solution: returned as given",
}


def _messages() -> Column:
    return F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])


# Fixed values in the registrations below: operation ids, parameter names, defaults, ranges and warning codes.
def standard() -> Registry:
    """Every operation of the library under its stable id."""
    r = Registry()
    side, extent = dict(low=0, high=1_000_000), dict(low=1, high=1_000_000)
    areal = dict.fromkeys(("Sq", "Sa", "Sp", "Sv", "Sz"), "z") | {"Ssk": "1", "Sku": "1"}
    line = dict.fromkeys(("Ra", "Rq", "Rp", "Rv", "Rz"), "z") | {"Rsk": "1", "Rku": "1"}
    cutoff = Param("cutoff", float, 0.8, 0.0, 1e9)
    box = (Param("left", int, 0, **side), Param("top", int, 0, **side))

    def derived(op_id, accepts, params, run, **more):
        r.add(Operation(op_id, accepts, tuple(params), run, "DerivedDataset", category="transform", **more))

    def artifact(op_id, accepts, params, run, units, **more):
        r.add(Operation(op_id, accepts, tuple(params), run, "Artifact", units, category="measure", **more))

    artifact("reference.identity", IMAGE, (), lambda d: d.scans.select("dataset_id", F.lit(1.0).alias("value")), {"value": "1"})
    artifact("image.statistics", IMAGE, (Param("binCount", int, 256, 1),), _statistics,
             dict.fromkeys(statistics.STATISTICS[:8], "z") | {"skewness": "1", "kurtosis": "1", "count": "1"},
             warnings=_statistics_warnings, tables=lambda d, p, shared: {"histogram": statistics.histogram(d, p["binCount"])})
    artifact("image.roughness", IMAGE, (), _roughness, areal, uses_region=True,
             warnings=_region_warnings("roughness.non-finite", "roughness.empty-region"))
    artifact("image.roughness-filtered", IMAGE, (cutoff,), gauss.filtered_roughness, areal, uses_region=True,
             applicable=_lengths, extra_errors=_positive_cutoff, rejects=lambda p: gauss.image_rejects(p["cutoff"]),
             warnings=_region_warnings("filtered-roughness.non-finite", "filtered-roughness.empty-region"))
    artifact("image.roi-statistics", IMAGE,
             (Param("shape", str, "Rectangle", choices=("Rectangle", "Ellipse")), *box,
              Param("width", int, 64, **extent), Param("height", int, 64, **extent)), regions.roi_statistics,
             dict.fromkeys(("Sq", "Sa", "Sz", "Mean", "Min", "Max"), "z") | {"PixelCount": "1"}, warnings=_roi_warnings, effective=_clamped_box,
             rejects=_origin((("x", "left"), ("y", "top"))))
    artifact("image.grains", IMAGE, (Param("threshold", float, 0.5, 0.0, 1.0), Param("minArea", int, 3, 1, 100_000)),
             lambda d, threshold, minArea: grains.grains(d, threshold, minArea),
             {"GrainCount": "1", "Coverage": "1", "MeanArea": "1", "MeanHeight": "z"}, warnings=_non_finite("grains.non-finite"))
    derived("image.flatten", IMAGE,
            (Param("scope", str, "Line", choices=flatten.SCOPES), Param("order", int, 1, 0, 8),
             Param("orientation", str, "FastAxis", choices=flatten.ORIENTATIONS),
             Param("basement", str, "RegressionToZero", choices=flatten.BASEMENTS)), flatten.flatten,
            warnings=lambda d, p, out: flatten.flatten_warnings(d, p["scope"], p["order"], p["orientation"]))
    derived("image.crop", IMAGE, (*box, Param("width", int, 128, **extent), Param("height", int, 128, **extent)), pixel.crop,
            effective=_clamped_box, rejects=_origin((("x", "left"), ("y", "top"))))
    derived("image.geometry", IMAGE, (Param("kind", str, "Rotate90Cw", choices=pixel.GEOMETRY_KINDS),), pixel.transform)
    derived("image.pixelmath", IMAGE, (Param("kind", str, "Invert", choices=pixel.PIXEL_KINDS), Param("amount", float, 0.0)), pixel.pixel_math,
            effective=lambda p: {} if p["kind"] in ("Offset", "Scale") else {"amount": 0.0})
    derived("image.filter", IMAGE, (Param("kind", str, "Mean", choices=stencil.FILTER_KINDS), Param("size", int, 3)),
            stencil.spatial_filter, extra_errors=_odd_size, effective=lambda p: {} if p["kind"] in stencil.SIZED else {"size": 3})
    derived("image.deglitch", IMAGE, (Param("threshold", float, 3.0, 0.1, 100.0),), stencil.deglitch)
    derived("image.fourier", IMAGE,
            (Param("kind", str, "LowPass", choices=spectral.FOURIER_KINDS), Param("lowCutoff", float, 0.1, 0.0, 1.0),
             Param("highCutoff", float, 0.5, 0.0, 1.0)),
            lambda d, kind, lowCutoff, highCutoff: spectral.fourier_filter(d, kind, lowCutoff, highCutoff),
            extra_errors=_cutoffs, effective=_band_cutoffs)
    derived("image.psd", IMAGE, (), spectral.psd_curves, applicable=lambda: _length_x() & (F.col("x.count") >= 2),
            rejects=lambda p: [(~_length_x(), *gauss.NOT_LENGTH), (F.col("x.count") < 2, "axis.too-short", "a line has fewer than two pixels")],
            warnings=lambda d, p, out: spectral.psd_warnings(d))
    derived("image.profile", IMAGE, (Param("orientation", str, "Row", choices=("Row", "Column")), Param("index", int, 0, **side)),
            pixel.cross_section, rejects=lambda p: _origin((("y" if p["orientation"] == "Row" else "x", "index"),))(p))
    derived("image.line-profile", IMAGE, (*[Param(n, float, 0.0) for n in ("x0", "y0", "x1", "y1")], Param("samples", int, 256, 2, 100_000)),
            _one_line, applicable=_lengths, effective=_clamped_line, rejects=_no_line)
    artifact("profile.roughness", CURVE, (), statistics.curve_roughness, line, warnings=lambda d, p, out: _gaps(
        d.samples, "profile-roughness.non-finite").unionByName(_flagged(out, F.isnan("Ra"), "profile-roughness.empty")))
    artifact("profile.roughness-filtered", CURVE, (cutoff,), gauss.filtered_curve_roughness,
             line | {"SamplingLengths": "1", "EvaluationLength": "x"}, applicable=_length_x, extra_errors=_positive_cutoff,
             warnings=_filtered_curve_warnings, rejects=lambda p: gauss.curve_rejects(p["cutoff"], whole=True))
    artifact("curve.range-statistics", CURVE, (Param("start", int, 0, 0), Param("count", int, 128, 1)), curve.range_statistics,
             dict.fromkeys(("RangeMin", "RangeMax", "RangeMean", "RangeRms", "PeakValue"), "z")
             | dict.fromkeys(("PeakPosition", "Centroid", "Fwhm"), "x") | {"Area": "zx"}, warnings=_range_warnings, effective=_clamped_count,
             rejects=_origin((("x", "start"),)))
    artifact("curve.peaks", CURVE,
             (Param("prominence", float, 0.1, 0.0, 1.0), Param("minSnr", float, 0.0, 0.0), Param("minWidth", float, 0.0, 0.0)),
             lambda d, shared, **p: peaks.dominant_peaks(d, shared), shared=lambda d, p: peaks.peak_table(d, p["prominence"], p["minSnr"], p["minWidth"]),
             units={"PeakCount": "1", "DominantPosition": "x", "DominantValue": "z", "DominantProminence": "z", "DominantWidth": "x", "DominantSnr": "1"},
             warnings=lambda d, p, out: _flagged(out, F.col("PeakCount") == 0, "peaks.none"),
             tables=lambda d, p, shared: {"peaks": shared})
    derived("profile.crop", CURVE, (Param("start", int, 0, 0), Param("count", int, 128, 1)), pixel.crop_curve, effective=_clamped_count,
            rejects=_origin((("x", "start"),)))
    derived("profile.flatten", CURVE, (Param("order", int, 1, 0, 8),), flatten.flatten_curves,
            warnings=lambda d, p, out: flatten.flatten_curve_warnings(d, p["order"]))
    derived("profile.smooth", CURVE, (Param("window", int, 5, 3), Param("order", int, 2, 0, 8)), curve.smooth, extra_errors=_window,
            rejects=lambda p: [(F.col("x.count") <= p["order"], "curve.too-short", "the curve has no more samples than the order")],
            warnings=_non_finite("profile-smooth.non-finite"))
    derived("profile.filter", CURVE, (Param("band", str, "Roughness", choices=gauss.BANDS), cutoff), gauss.gaussian_filter,
            applicable=_length_x, extra_errors=_positive_cutoff, rejects=lambda p: gauss.curve_rejects(p["cutoff"]))
    derived("profile.baseline", CURVE, (Param("lambda", float, 1e5, 1.0), Param("p", float, 0.01, 1e-4, 0.5), Param("iterations", int, 10, 1, 100)),
            lambda d, p, iterations, **lam: baseline.baseline(d, lam["lambda"], p, iterations), warnings=lambda d, p, out: baseline.baseline_warnings(d, out))
    return r


def humanise(name: Column) -> Column:
    """Display label of a camelCase key."""
    spaced = F.regexp_replace(name, "(?<=[^A-Z])([A-Z])", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), spaced.substr(F.lit(2), F.length(spaced)))


__all__ = ["CURVE", "IMAGE", "Operation", "Param", "Registry", "Result", "coerce", "humanise", "standard", "validate"]
