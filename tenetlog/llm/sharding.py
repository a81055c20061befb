"""Sharding: minimax contiguous partition of copy groups by bytes.

Rows with equal texts share a hash, and the top bits of the hash name a block; blocks in
hash order are the ordered atomic groups, so copies never part. There are at most
``2 ** BLOCK_BITS`` blocks however large the table is, so their sizes fit the driver.
A block above the mean size of what is left takes a shard of its own (no partition can
do better for it); over the rest, a binary search finds the least capacity for which
greedy filling needs no more shards than there are. Greedy filling leaves what is short to
the last shard, so the cuts are made where the smallest shard under that capacity is largest.

Slots need no ordered pass over a shard: rows are ranked inside (shard, lane), where the
lane is a hash of the id, and a lane starts where the lanes before it end.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenetlog.llm import common

SHARDS, BLOCK_BITS, LANES, OVERHEAD = 40, 16, 256, 16


def sized(docs: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, size, text_crc32, block) per row. A null text has no bytes, a null crc and a block of its own kind."""
    raw = F.col("text").cast("binary")
    return common.keyed(docs).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - block_bits).cast("int").alias("block"),
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(LANES)).cast("int").alias("lane"))


def feasible(sizes: list[int], capacity: int, shards: int) -> list[int] | None:
    """Start of each shard if greedy filling up to ``capacity`` needs at most ``shards``."""
    starts, filled = [], capacity + 1
    for k, size in enumerate(sizes):
        if filled + size > capacity:
            starts.append(k)
            if len(starts) > shards or size > capacity:
                return None
            filled = 0
        filled += size
    return starts


def reachable(ends: list[int], least: int, capacity: int, shards: int) -> list[int]:
    """For each place the numbers of shards, as bits, that can end there with sizes from ``least`` to ``capacity``."""
    masks, allowed = [1] + [0] * (len(ends) - 1), (1 << (shards + 1)) - 1
    # The places a shard may start at form a window that moves on; two stacks hold the union of its bits.
    front: list[tuple[int, int]] = []
    back, back_bits, low, entered = [], 0, 0, 0
    for j in range(1, len(ends)):
        while entered < j and ends[j] - ends[entered] >= least:
            back.append(masks[entered])
            back_bits |= masks[entered]
            entered += 1
        while low < entered and ends[j] - ends[low] > capacity:
            if not front:
                bits = 0
                for mask in reversed(back):
                    bits |= mask
                    front.append((mask, bits))
                back, back_bits = [], 0
            front.pop()
            low += 1
        masks[j] = ((back_bits | (front[-1][1] if front else 0)) << 1) & allowed
    return masks


def even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Start of each shard: none above ``capacity``, and the smallest as large as it can be under that."""
    ends = [0, *accumulate(sizes)]
    low, high = 0, ends[-1] // shards
    masks = reachable(ends, 0, capacity, shards)
    used = masks[-1].bit_length() - 1              # fewer than ``shards`` only where there are fewer groups
    while low < high:
        middle = (low + high + 1) // 2
        found = reachable(ends, middle, capacity, shards)
        if found[-1] >> used & 1:
            low, masks = middle, found
        else:
            high = middle - 1
    starts, end = [], len(sizes)
    for left in range(used - 1, -1, -1):
        goal = ends[end] * left / (left + 1)
        inside = [k for k in range(bisect_left(ends, ends[end] - capacity), end) if ends[end] - ends[k] >= low and masks[k] >> left & 1]
        end = min(inside, key=lambda k: abs(ends[k] - goal))
        starts.append(end)
    return starts[::-1]


def minimax(sizes: list[int], shards: int) -> list[int]:
    """Starts of the shards of a contiguous partition whose largest shard is as small as can be."""
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if feasible(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return even_cuts(sizes, low, shards)


def plan(blocks: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each block, from (block, size) pairs."""
    blocks = sorted(blocks)
    alone, rest, left = [], dict(blocks), shards
    for block, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        if left <= 1 or size * left <= sum(rest.values()) or len(rest) <= 1:
            break
        alone.append(block)
        del rest[block]
        left -= 1
    order = list(rest)
    starts = minimax([rest[b] for b in order], left) if order else []
    found, shard = {}, -1
    for k, block in enumerate(order):
        shard += k in set(starts)
        found[block] = shard
    return found | {block: left + k for k, block in enumerate(alone)}


def shard_table(docs: DataFrame, shards: int = SHARDS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    Law ``bytes``: sizes are as equal as unbroken copy groups allow. Repeated rows each get
    a slot; null ids share a lane; an empty table gives no rows. ``grown_shard`` is null.
    """
    rows = common.stored(sized(docs, block_bits), "shard-rows")
    spark = docs.sparkSession
    blocks = [(r["block"], r["size"]) for r in rows.groupBy("block").agg(F.sum("size").alias("size")).collect()]
    table = spark.createDataFrame(list(plan(blocks, shards).items()), "block int, shard int")   # 2 ** block_bits rows at most
    placed = rows.join(F.broadcast(table), "block")
    counts = placed.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))                   # shards * LANES rows
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = counts.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32"))
    slot: Column = (F.col("first") + F.col("rank") - 1).cast("long")
    return (placed.withColumn("rank", rank).join(F.broadcast(lanes), ["shard", "lane"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
