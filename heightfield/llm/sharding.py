"""Shards of near equal bytes through fixed virtual slots.

A record belongs for good to one of some thousands of virtual slots, by a hash of its id.  A table of versions maps slots to shards: version 1 deals the
slots out in turn; each rebalancing looks at the bytes of every slot and moves slots from heavy to light shards, and is
stored as the next version.  Only the slots' totals (one row per slot) reach the driver; records stay in DataFrame operations throughout.

Defined results: null text has size 16 and no bytes; a null id has a slot of its own hash; repeated rows are placed each; an empty
table gives no rows; equal totals move the smaller slot to the smaller shard.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from heightfield.llm import common as C

SHARDS, SLOTS = 40, 8192
# Bytes a record takes besides its text.
OVERHEAD = 16
# Shards whose bytes differ by less than this share of a shard are left as they are.
CLOSE = 0.0005


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       F.pmod(F.xxhash64(F.col("doc_id")), F.lit(slots)).cast("int").alias("vslot"))


def dealt_in_turn(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(current: list[int], weight: list[int], shards: int, close: float = CLOSE) -> list[int]:
    """The map edited so that the shards weigh nearly the same: slots move from the heaviest shard to the lightest, or change places with
    lighter ones, as long as this brings the two closer."""
    shard_of = list(current)
    total = [0] * shards
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, s in enumerate(shard_of):
        total[s] += weight[slot]
        held[s].append(slot)
    bound = close * sum(weight) / shards
    for _ in range(8 * len(current)):
        hi = max(range(shards), key=lambda s: (total[s], -s))
        lo = min(range(shards), key=lambda s: (total[s], s))
        gap = total[hi] - total[lo]
        if gap <= bound:
            break
        # what should cross is half the gap: one slot, or one slot against a lighter one
        give = sorted(held[hi], key=lambda v: (weight[v], v))
        take = sorted(held[lo], key=lambda v: (weight[v], v))
        best = min(((abs(gap / 2 - weight[v]), v, -1) for v in give if 0 < weight[v] < gap), default=None)
        j = 0
        for v in give:
            while j + 1 < len(take) and weight[v] - weight[take[j + 1]] >= gap / 2:
                j += 1
            for u in take[j:j + 2]:
                moved = weight[v] - weight[u]
                if 0 < moved < gap and (best is None or (abs(gap / 2 - moved), v, u) < best):
                    best = (abs(gap / 2 - moved), v, u)
        if best is None:
            break
        _, v, u = best
        for slot, a, b in ((v, hi, lo), (u, lo, hi)):
            if slot >= 0:
                held[a].remove(slot)
                held[b].append(slot)
                shard_of[slot] = b
                total[a] -= weight[slot]
                total[b] += weight[slot]
    return shard_of


def map_table(spark, versions: list[list[int]]) -> DataFrame:
    """(version, vslot, shard): the maps as rows, one per version and slot."""
    maps = F.from_json(F.lit(json.dumps(versions)), "array<array<int>>")
    rows = spark.range(1).select(F.posexplode(maps).alias("version", "map"))
    return rows.select((F.col("version") + 1).alias("version"), F.posexplode("map").alias("vslot", "shard"))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0) and vslot of every record, by the latest map."""
    spark = docs.sparkSession
    rows = C.stored(sized(docs, slots), "sized")
    per_slot = C.stored(rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slots")
    weight = [0] * slots
    for r in per_slot.collect():  # one row per virtual slot
        weight[r["vslot"]] = r["bytes"]
    first = dealt_in_turn(slots, shards)
    table = C.stored(map_table(spark, [first, rebalance(first, weight, shards)]), "slot-map")
    latest = table.filter(F.col("version") == 2).select("vslot", "shard")
    # place of each slot's records within its shard: the records of the slots before it
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    start = latest.join(per_slot, "vslot").select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("nth", nth).join(F.broadcast(start), "vslot")  # the map has one row per virtual slot
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), "vslot")
