import math

import numpy as np
import pytest
from helpers import curves, grids, images, lines
from pyspark.sql import functions as F

from heightfield.functions import units
from heightfield.functions.regions import polygon, rectangle
from heightfield.operators import lineage, peaks, regions, registry

OPS = registry.standard()


def by_parent(result):
    """Values of each result under the id of its input."""
    names = {r["dataset_id"]: r["parent_id"] for r in result.scans.collect()}
    values = (grids if hasattr(result, "pixels") else lines)(result, str)
    return {names[k]: v for k, v in values.items()}


def test_every_operation_is_registered_once():
    assert len(OPS.all()) == 25 and len(OPS.for_kind("ScanImage")) == 16
    with pytest.raises(ValueError):
        OPS.add(OPS.get("image.crop"))


@pytest.mark.parametrize("values,complaint", [
    ({"bogus": 1}, "not a parameter"), ({"order": None}, "no value"), ({"order": 1.5}, "expected int"), ({"order": True}, "expected int"),
    ({"order": 9}, "too large"), ({"order": -1}, "too small"), ({"scope": "Sideways"}, "choices")])
def test_validation(values, complaint):
    errors = registry.validate(OPS.get("image.flatten").params, values)
    assert len(errors) == 1 and complaint in errors[0]
    assert "finite" in registry.validate(OPS.get("image.grains").params, {"threshold": math.nan})[0]
    assert "required" in registry.validate((registry.Param("need", int),), {})[0]


def test_coercion_of_text_and_codes():
    p = OPS.get("image.flatten").params
    assert registry.coerce(p, {"scope": "surface", "order": "2", "orientation": 1}) == {"scope": "Surface", "order": 2, "orientation": "SlowAxis"}
    assert registry.validate(p, registry.coerce(p, {"order": "two"}))


def test_run_gives_one_result_with_steps_and_warnings(spark):
    a = np.arange(20.0).reshape(4, 5)
    a[0, 0] = math.nan
    im = images(spark, a, np.zeros((4, 5)))
    res = OPS.run("image.statistics", im, {"binCount": 8})
    assert res.derived is None and res.measurements.count() == 22
    warned = {(r["input_dataset_id"], tuple(r["warnings"])) for r in res.steps.collect()}
    assert warned == {(0, ("statistics.non-finite",)), (1, ("statistics.degenerate-range",))}
    res = OPS.run("image.flatten", im, {"scope": 2})
    assert res.measurements is None and np.isnan(by_parent(res.derived)["0"]).all()
    step = res.steps.filter("input_dataset_id = 1").first()
    assert step["parameters"] == {"scope": 2.0, "order": 1.0, "orientation": 0.0, "basement": 0.0}
    again = OPS.run("image.flatten", im, {"scope": "Surface"}).steps.filter("input_dataset_id = 1").first()
    assert again["artifact_id"] == step["artifact_id"]


@pytest.mark.parametrize("op", [o.id for o in OPS.all()])
def test_every_operation_runs_with_its_defaults(spark, op):
    rng = np.random.default_rng(1)
    data = images(spark, rng.normal(size=(24, 30))) if OPS.get(op).accepts == "ScanImage" else curves(spark, rng.normal(size=80))
    values = {"x1": 9.0, "y1": 5.0} if op == "image.line-profile" else {}
    res = OPS.run(op, data, values)
    if res.measurements is not None:
        rows = res.measurements.collect()
        assert rows and all(math.isfinite(r["value"]) for r in rows if r["name"] not in ("DominantWidth", "Fwhm"))
    elif hasattr(res.derived, "pixels"):
        assert np.isfinite(by_parent(res.derived)["0"]).all()
    else:
        assert np.isfinite(by_parent(res.derived)["0"]).all()
    assert res.steps.count() == 1 and res.rejects.count() == 0
    if res.derived is not None:
        assert {r["artifact_id"] for r in res.steps.collect()} == {r["dataset_id"] for r in res.derived.scans.collect()}


def test_rejections(spark):
    im = images(spark, np.zeros((3, 3)))
    for op, values in (("image.filter", {"size": 4}), ("image.fourier", {"kind": "BandPass", "lowCutoff": 0.6}), ("image.roughness-filtered", {"cutoff": 0.0}),
                       ("profile.roughness", {})):
        with pytest.raises(ValueError):
            OPS.run(op, im, values)
    assert OPS.applicable(images(spark, np.zeros((3, 3)), unit="V").scans).filter("operation_id = 'image.psd'").count() == 0


def test_units_round_trip_and_composites(spark):
    extra = [units.psd_unit("nm", "um"), units.psd_unit("um", "um"), units.psd_unit("pN", "um"), units.product_unit("nm", "um"), units.inverse_unit("um")]
    rows = spark.createDataFrame([(2.0, "nm²·um", "um²·um"), (2.0, "nm²·um", "pN²·um"), (25.0, "degC", "K"), (1.0, "1/um", "1/cm"), (1.0, "x", "m")],
                                 "v double, s string, t string")
    out = rows.select(units.convert(F.col("v"), F.col("s"), F.col("t"), extra).alias("r")).select("r.*").collect()
    assert [r["value"] for r in out][:1] == pytest.approx([2e-6]) and out[1]["value"] is None and "cannot" in out[1]["error"]
    assert out[2]["value"] == pytest.approx(298.15) and out[3]["value"] == pytest.approx(1e4) and out[4]["error"] == "unknown unit"
    assert len(units.UNITS) == 37 and units.units_table(spark).select("dimension").distinct().count() == 11


def test_composed_units_are_units(spark):
    rows = spark.createDataFrame([(2.0, "nm²·um", "um²·um"), (2.0, "nm·um", "um·um"), (1.0, "1/um", "1/cm"), (1.0, "nm²·um", "nm·um"), (1.0, "1/V", "1/m")],
                                 "v double, s string, t string")
    out = rows.select(units.convert(F.col("v"), F.col("s"), F.col("t")).alias("r")).select("r.*").collect()
    assert [r["value"] for r in out][:3] == pytest.approx([2e-6, 2e-3, 1e4])
    assert out[3]["error"] == "cannot convert Length^2*Length to Length*Length" and out[4]["error"] == "unknown unit"


def test_humanised_labels(spark):
    rows = spark.createDataFrame([("meanAbsoluteDeviation",), ("order",), ("minSNR",)], "k string")
    assert [r[0] for r in rows.select(registry.humanise(F.col("k"))).collect()] == ["Mean Absolute Deviation", "Order", "Min SNR"]


def links(spark, *pairs):
    return spark.createDataFrame(list(pairs), "dataset_id bigint, parent_id bigint")


def test_descendants_are_cycle_guarded_and_deep(spark):
    chain = links(spark, (0, None), *[(k, k - 1) for k in range(1, 40)], (100, 101), (101, 100), (200, 999))
    ids = spark.createDataFrame([(30,), (100,)], "dataset_id bigint")
    got = sorted(r[0] for r in lineage.descendants(chain, ids).collect())
    assert got == [*range(31, 40), 101]
    assert sorted(r[0] for r in lineage.cycles(chain).collect()) == [100, 101]
    assert sorted(r[0] for r in lineage.roots(chain).collect()) == [0, 200]


def test_self_loop_and_acyclic(spark):
    assert [r[0] for r in lineage.cycles(links(spark, (1, 1), (2, 1))).collect()] == [1]
    assert lineage.cycles(links(spark, (1, None), (2, 1), (3, 2))).count() == 0


def test_removal_policies(spark):
    table = links(spark, (1, None), (2, 1), (3, 2), (4, None))
    gone = spark.createDataFrame([(1,), (4,)], "dataset_id bigint")
    kept = lineage.remove({"t": table}, table, gone, "Block")["t"]
    assert sorted(r[0] for r in kept.collect()) == [1, 2, 3]
    kept = lineage.remove({"t": table}, table, gone, "Cascade")["t"]
    assert kept.count() == 0


def test_regions_enter_measurements_and_provenance(spark):
    im = images(spark, np.arange(30.0).reshape(5, 6))
    areas = [rectangle(1, 0, 0, 3, 2), polygon(2, [(50, 50), (60, 50), (55, 60)])]
    res = OPS.run("image.roughness", im, areas=areas)
    sz = {r["region_id"]: r["value"] for r in res.measurements.filter("name = 'Sz'").collect()}
    assert sz[1] == 8 and math.isnan(sz[2])
    steps = {r["parameters"]["regionShape"]: r for r in res.steps.collect()}
    assert steps[0.0]["parameters"]["regionWidth"] == 3 and steps[2.0]["parameters"]["regionX2"] == 55
    assert (steps[0.0]["warnings"], steps[2.0]["warnings"]) == ([], ["roughness.empty-region"])
    assert {r[0] for r in res.steps.select("artifact_id").collect()} == {r[0] for r in res.measurements.select("artifact_id").distinct().collect()}
    with pytest.raises(ValueError):
        OPS.run("image.grains", im, areas=areas)


def test_effective_parameters_and_side_tables(spark):
    im = images(spark, np.arange(30.0).reshape(5, 6))
    assert OPS.run("image.crop", im, {"left": 4}).steps.first()["parameters"] == {"left": 4, "top": 0, "width": 2, "height": 5}
    assert OPS.run("image.pixelmath", im, {"amount": 7.0}).steps.first()["parameters"]["amount"] == 0
    assert OPS.run("image.fourier", im).steps.first()["parameters"]["lowCutoff"] == 0
    assert OPS.run("image.statistics", im, {"binCount": 4}).tables["histogram"].count() == 4
    c = curves(spark, [0, 3, 0, 1, 0], [1, 1, 1], [math.nan, math.nan])
    res = OPS.run("curve.peaks", c)
    assert res.tables["peaks"].count() == 2 and res.warnings.filter("code = 'peaks.none'").count() == 2
    codes = sorted((r["dataset_id"], r["code"]) for r in OPS.run("curve.range-statistics", c).warnings.collect())
    assert codes == [(2, "range-statistics.empty"), (2, "range-statistics.non-finite")]
    holes = images(spark, [[math.nan, 1.0], [2.0, 3.0]])
    assert [r["code"] for r in OPS.run("image.roi-statistics", holes, {"width": 1, "height": 1}).warnings.orderBy("code").collect()] == ["roi.empty", "roi.non-finite"]


def test_members_that_do_not_fit_are_named(spark):
    two = images(spark, np.zeros((3, 3)), np.zeros((9, 9)))
    res = OPS.run("image.crop", two, {"left": 5, "top": 5, "width": 2, "height": 2})
    assert [tuple(r) for r in res.rejects.select("dataset_id", "operation_id", "code").collect()] == [(0, "image.crop", "origin.outside")]
    assert set(by_parent(res.derived)) == {"1"} and res.steps.count() == 1
    volts = OPS.run("image.psd", images(spark, np.zeros((3, 3)), unit="V"), {})
    assert [r["code"] for r in volts.rejects.collect()] == ["axis.not-length"] and volts.derived.scans.count() == 0
    step = OPS.run("image.pixelmath", two, {"kind": "Offset", "amount": 2.0}).steps.first()
    assert step["parameter_units"] == {"kind": "1", "amount": two.scans.first()["channel"]["unit"]} and step["library_version"] and step["ran_at"]


def test_singular_baselines_are_told(spark):
    two = curves(spark, np.arange(40.0), np.zeros(40))
    res = OPS.run("profile.baseline", two, {"lambda": 1.7e308})
    assert [tuple(r) for r in res.warnings.select("dataset_id", "code").collect()] == [(0, "profile-baseline.singular")]
    assert OPS.run("profile.baseline", two, {}).warnings.count() == 0


def counted(spark, rows):
    """The rows, with an accumulator of how many of them were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(count, rows.schema), seen


def all_read(res):
    for df in (res.measurements, res.warnings, res.steps, res.rejects, *res.tables.values()):
        df.collect()


@pytest.mark.parametrize("op", ["curve.peaks", "image.roi-statistics"])
def test_an_operation_is_evaluated_once_per_run(spark, op):
    rng = np.random.default_rng(2)
    if op == "curve.peaks":
        data = curves(spark, rng.normal(size=90), [1.0] * 20)
        rows, seen = counted(spark, data.samples)
        peaks.peak_table(data.with_samples(rows), 0.1).collect()
        data = data.with_samples(rows)
    else:
        data = images(spark, rng.normal(size=(20, 30)))
        rows, seen = counted(spark, data.pixels)
        data = data.with_pixels(rows)
        regions.roi_statistics(data).collect()
        regions.roi_pixels(data).collect()
    once = seen.value
    all_read(OPS.run(op, data))
    assert once and seen.value == 2 * once


def test_warnings_carry_messages_and_steps_say_where_and_when(spark):
    res = OPS.run("curve.peaks", curves(spark, [1.0] * 9))
    assert [(r["code"], r["message"]) for r in res.warnings.collect()] == [("peaks.none", registry.MESSAGES["peaks.none"])]
    step = res.steps.first()
    assert step["warning_details"] == [("peaks.none", registry.MESSAGES["peaks.none"])] and step["errors"] == []
    assert step["ran_at"] == res.steps.first()["ran_at"] and step["step_id"] == res.steps.first()["step_id"] and step["seconds"] > 0
    assert set(step["environment"]) == {"library", "spark", "python", "system"}
    again = OPS.run("curve.peaks", curves(spark, [1.0] * 9)).steps.first()
    assert again["artifact_id"] == step["artifact_id"] and again["step_id"] != step["step_id"]


def test_recorded_parameter_sets_have_the_problems_that_validation_tells(spark):
    rows = [(1, "image.flatten", "order", 9.0), (1, "image.flatten", "scope", 3.0), (2, "image.flatten", "order", 1.5), (2, "image.flatten", "bogus", 1.0),
            (3, "image.flatten", "order", -1.0), (3, "image.flatten", "orientation", 1.0), (4, "image.grains", "threshold", math.nan), (5, "nothing", "x", 0.0),
            (6, "image.flatten", "order", None), (7, "image.grains", "minArea", 3.0), (8, "image.flatten", "basement", 0.5)]
    got = {(r["set_id"], r["parameter"]): r["problem"] for r in OPS.problems(spark.createDataFrame(rows, "set_id int, operation_id string, parameter string, value double")).collect()}
    assert got == {(1, "order"): "too large", (1, "scope"): "no such choice", (2, "order"): "not a whole number", (2, "bogus"): "unknown parameter", (3, "order"): "too small",
                   (4, "threshold"): "not finite", (5, "x"): "unknown operation", (6, "order"): "no value", (8, "basement"): "no such choice"}
    need = registry.Registry()
    need.add(registry.Operation("own", "ScanImage", (registry.Param("must", int),), lambda d: d, "DerivedDataset"))
    sets = spark.createDataFrame([(1, "own", "must", 2.0), (2, "own", "other", 2.0)], "set_id int, operation_id string, parameter string, value double")
    assert {tuple(r) for r in need.problems(sets).collect()} == {(2, "own", "other", "unknown parameter"), (2, "own", "must", "required")}
