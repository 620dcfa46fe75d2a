"""Derivation lineage of datasets and the measurements attached to them.

``links`` tables are (dataset_id, parent_id), one row per dataset, parent_id NULL for a source.  One parent may have nearly all rows as its
children: joins by a parent deal the rows of heavy parents out (:mod:`heightfield.plans.skew`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightfield.plans.iterate import cut
from heightfield.plans.skew import join_unique


def parents(links: DataFrame) -> DataFrame:
    """Keep a parent only where it is present itself; otherwise the dataset counts as a root (NULL)."""
    known = links.select(F.col("dataset_id").alias("parent_id"), F.lit(True).alias("_known"))
    return join_unique(links, known, "parent_id", "left", "dataset_id").select(
        "dataset_id", F.when(F.col("_known"), F.col("parent_id")).alias("parent_id"))


def roots(links: DataFrame) -> DataFrame:
    """Datasets without a present parent."""
    known = links.select(F.col("dataset_id").alias("parent_id"))
    return join_unique(links, known, "parent_id", "left_anti", "dataset_id").select("dataset_id")


def descendants(links: DataFrame, targets: DataFrame) -> DataFrame:
    """All transitive children of ``targets`` (dataset_id): distinct (dataset_id), targets excluded.

    Every dataset has one parent, so the walk upward doubles its stride each round: the number
    of rounds is the logarithm of the depth, and a cycle ends as soon as strides stop
    discovering anything new.
    """
    marks = targets.select(F.col("dataset_id").alias("up"), F.lit(True).alias("_t")).distinct()
    start = parents(links).select("dataset_id", F.col("parent_id").alias("up")).filter("up is not null")
    start = cut(start)
    size = start.count()
    state = cut(join_unique(start, marks, "up", "left", "dataset_id", size).select("dataset_id", "up", F.coalesce("_t", F.lit(False)).alias("hit")))
    hits, stride = state.filter("hit").count(), 1
    while True:
        far = state.select(F.col("dataset_id").alias("up"), F.col("up").alias("up2"), F.col("hit").alias("hit2"))
        state = cut(join_unique(state, far, "up", "left", "dataset_id", size).select(
            "dataset_id", F.col("up2").alias("up"), (F.col("hit") | F.coalesce("hit2", F.lit(False))).alias("hit")))
        stride *= 2
        now = state.agg(F.count(F.when(F.col("hit"), 1)), F.count("up")).first()
        if not now[1]:
            break
        if now[0] == hits:  # nothing new this round: done once every distinct chain has been walked
            if stride > size:
                break
        hits = now[0]
    return state.filter("hit").select("dataset_id").join(
        targets.select("dataset_id"), "dataset_id", "left_anti")


def cycles(links: DataFrame) -> DataFrame:
    """Datasets that are their own ancestor.

    Strides double; each round keeps only the datasets that are met by a stride from another one still kept, which no member of a cycle
    fails to be.  Once none drops out, the stride maps what is left onto itself, so all of it lies on cycles: the number of rounds is the
    logarithm of the longest way into a cycle, and the rows of a round shrink with every stride.
    """
    state = cut(parents(links).select("dataset_id", F.col("parent_id").alias("up")).filter("up is not null"))
    total = state.count()
    while total:
        met = state.select(F.col("up").alias("dataset_id")).distinct().hint("merge")
        live = cut(state.join(met, "dataset_id", "left_semi"))
        left = live.count()
        if left == total:
            break
        far = live.select(F.col("dataset_id").alias("up"), F.col("up").alias("up2"))
        state = cut(join_unique(live, far, "up", "inner", "dataset_id", left).select("dataset_id", F.col("up2").alias("up")))
        total = state.count()
    return state.select("dataset_id")


def blocked(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets a blocking removal must refuse: those with at least one child."""
    children = links.select(F.col("parent_id").alias("dataset_id")).distinct()
    return targets.select("dataset_id").join(children, "dataset_id", "left_semi")


def remove(tables: dict[str, DataFrame], links: DataFrame, targets: DataFrame, policy: str = "Block") -> dict[str, DataFrame]:
    """Drop targets from every table keyed by dataset_id.

    Block keeps targets that still have children; Cascade drops their descendants as well.
    """
    if policy == "Block":
        gone = targets.select("dataset_id").join(blocked(links, targets), "dataset_id", "left_anti")
    elif policy == "Cascade":
        gone = targets.select("dataset_id").unionByName(descendants(links, targets))
    else:
        raise ValueError(f"unknown removal policy {policy!r}")
    return {name: t.join(gone, "dataset_id", "left_anti") for name, t in tables.items()}


def measurements_of(measurements: DataFrame, sources: DataFrame) -> DataFrame:
    """Measurements whose source is listed; an artifact attached twice counts once.

    ``measurements`` is (artifact_id, source_id, operation_id, name, value, unit).
    """
    once = measurements.dropDuplicates(["artifact_id", "name"])
    return join_unique(once, sources.select(F.col("dataset_id").alias("source_id")).distinct(), "source_id", "left_semi", "artifact_id")


def enum_labels(steps: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace recorded parameter codes by names where operation and version match.

    ``steps`` is (..., operation_id, operation_version, parameter, value) and ``labels``
    (operation_id, operation_version, parameter, code, label); an unmatched code keeps NULL.
    """
    named = labels.withColumnRenamed("code", "value")
    return steps.join(named, ["operation_id", "operation_version", "parameter", "value"], "left")
