"""Lineage where one parent holds nearly all rows."""

import pytest
from pyspark.sql import functions as F

from heightfield.operators import lineage
from heightfield.plans import skew


@pytest.fixture
def star(spark, monkeypatch):
    """Nine tenths of the datasets are children of dataset 1, the others a chain below dataset 2; the last two form a cycle."""
    monkeypatch.setattr(skew, "HEAVY_ROWS", 100)
    n = 4000
    parent = (F.when(F.col("id") < 1, None).when(F.col("id") == 1, 0).when(F.col("id") == n - 1, n - 2).when(F.col("id") == n - 2, n - 1)
              .when(F.col("id") % 10 == 2, F.col("id") - 10).otherwise(1))
    return spark.range(n).select(F.col("id").alias("dataset_id"), parent.cast("long").alias("parent_id"))


def test_rows_of_a_heavy_key_spread_over_tasks(spark, star):
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "16")):
        spark.conf.set(key, value)
    try:
        known = star.select(F.col("dataset_id").alias("parent_id"), F.lit(True).alias("k"))
        joined = skew.join_unique(star, known, "parent_id", "left", "dataset_id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in star.join(known, "parent_id", "left").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for key, value in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.autoBroadcastJoinThreshold", "10485760"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(key, value)
    assert sum(sizes) == sum(plain) == star.count()
    assert max(plain) > 3500 and max(sizes) < 1000


def test_walks_over_a_heavy_parent(spark, star):
    up = {r.dataset_id: r.parent_id for r in star.collect()}

    def below(k, top):
        seen = set()
        while k in up and up[k] is not None and k not in seen:
            seen.add(k)
            k = up[k]
            if k == top:
                return True
        return False

    def got(df):
        return sorted(r[0] for r in df.select("dataset_id").collect())

    for top in (0, 1, 2, 12):
        target = spark.createDataFrame([(top,)], "dataset_id bigint")
        assert got(lineage.descendants(star, target)) == sorted(k for k in up if k != top and below(k, top))
    assert got(lineage.cycles(star)) == [3998, 3999]
    assert got(lineage.roots(star)) == sorted(k for k, p in up.items() if p not in up)
    assert {r.dataset_id: r.parent_id for r in lineage.parents(star).collect()} == {k: p if p in up else None for k, p in up.items()}
    assert got(lineage.blocked(star, spark.createDataFrame([(1,), (3,)], "dataset_id bigint"))) == [1]


def test_measurements_of_one_source_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 10)
    rows = spark.range(300).select(F.col("id").alias("artifact_id"), F.when(F.col("id") % 20 == 0, 2).otherwise(1).alias("source_id"), F.lit("o").alias("operation_id"),
                                   F.lit("n").alias("name"), F.lit(1.0).alias("value"), F.lit("um").alias("unit"))
    found = lineage.measurements_of(rows.unionByName(rows), spark.createDataFrame([(1,)], "dataset_id int"))
    assert found.count() == 285


def test_cycles_take_rounds_by_the_way_into_them_not_by_the_table(spark, monkeypatch):
    import random

    draw = random.Random(5)
    parent = {k: draw.choice([None, k // 2, k // 3, 10_000 + k]) for k in range(1, 3000)}
    parent |= {7: 7, 20: 21, 21: 22, 22: 20, 100: 101, 101: 100, 200: 7, 201: 200}
    links = spark.createDataFrame(list(parent.items()), "dataset_id bigint, parent_id bigint")

    def returns(k):
        at = parent.get(k)
        for _ in parent:
            if at is None or at == k:
                return at == k
            at = parent.get(at)
        return False

    rounds = []
    monkeypatch.setattr(lineage, "cut", lambda df, real=lineage.cut: rounds.append(1) or real(df))
    assert sorted(r[0] for r in lineage.cycles(links).collect()) == [k for k in parent if returns(k)] == sorted([7, 20, 21, 22, 100, 101])
    assert len(rounds) <= 11  # one per power of two in the table made 12
