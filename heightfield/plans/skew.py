"""Joins of rows to a table of unique keys where one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task meets; keys that are split at most (beyond, the first bound grows with the table instead).
HEAVY_ROWS, HEAVY_KEYS = 200_000, 10_000


def heavy_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the keys with too many rows for one task: at most HEAVY_KEYS of them, by the way the bound is set.

    The counts are a hash aggregate with map-side combine, so no key is gathered to be counted.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    bound = max(HEAVY_ROWS, -(-total // HEAVY_KEYS))
    return counts.filter(F.col("n") > bound).select(key, F.ceil(F.col("n") / bound).cast("int").alias("parts"))


def join_unique(rows: DataFrame, table: DataFrame, key: str, how: str, spread: str, total: int | None = None) -> DataFrame:
    """``rows.join(table, key, how)`` for a table with one row per key: the rows of a heavy key are dealt out by ``spread``, and the
    table's row of that key, only that one, is repeated once per part.

    ``total`` is the number of rows, counted where it is not given; too few rows for any key to be heavy are joined as they are.  More rows are
    merged by hint: a table as long as they are may be estimated small enough, by its compressed bytes, to be broadcast through the driver.
    """
    total = rows.select(key).count() if total is None else total
    if total <= HEAVY_ROWS:
        return rows.join(table, key, how)
    heavy = F.broadcast(heavy_keys(rows, key, total))  # at most HEAVY_KEYS rows
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("parts"))).cast("int")
    dealt = rows.join(heavy, key, "left").withColumn("_part", part).drop("parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    repeated = table.join(heavy, key, "left").withColumn("_part", parts).drop("parts").hint("merge")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")
