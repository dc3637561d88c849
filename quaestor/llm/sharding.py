"""Sharding: groups of equal texts, longest processing time first."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen

SHARDS = 16
#: Leading bits of a group's size that make its class: groups of a class differ by under 2**(1 - BITS).
BITS = 10


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For classes (class, groups, bytes of all its groups): of each class, how many of its groups go to each shard, in
    shard order. Goes from the largest class down and gives each group to the least loaded shard through a heap; of a
    class with many groups, those that are sure to go to a shard are given at once."""
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for name, groups, total in sorted(classes, reverse=True):
        size, left, counts = total / groups, groups, [0] * shards
        if groups > 4 * shards:
            loads = sorted(heap)
            while loads and (level := (sum(x for x, _ in loads) + total) / len(loads)) < loads[-1][0]:
                loads.pop()  # above the level that the others reach
            sure = {s: max(0, int((level - x) / size) - 1) for x, s in loads}
            for s, n in sure.items():
                counts[s] += n
                left -= n
            heap = [(x + size * sure.get(s, 0), s) for x, s in heap]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            counts[s] += 1
        out.append((name, counts))
    return out


def ranked(df: DataFrame, group: str, order: tuple[str, ...], rank: str) -> DataFrame:
    """df with each row's place, from 0, within its `group` by `order`. One range sort over group and order, so a large
    group spreads over partitions; a row for each partition and group adds up what lies before."""
    # Fixed once: the places below refer to these very partitions.
    placed = frozen(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    firsts = placed.groupBy(part.alias("_part"), group).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    firsts = firsts.withColumn("_before", F.sum("_own").over(Window.partitionBy(group).orderBy("_part")) - F.col("_own"))
    # At most one row for each partition and each group that starts in one: bounded by partitions plus groups.
    joined = placed.withColumn("_part", part).join(F.broadcast(firsts), ["_part", group])
    return joined.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_own", "_before")


def size_class(size: Column, bits: int = BITS) -> Column:
    """The size with all but its leading bits cleared: at most 2**(bits - 1) classes for each power of two."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - bits, F.lit(0))).cast("long")
    return size - size % step


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): size is the text's UTF-8 bytes plus 1 (a null text counts as empty). Equal
    texts lie in one shard, and the shards' bytes are near equal: groups of equal texts go, from the largest down, to the
    least loaded shard. Slots number a shard's rows from 0 by doc_id; repeated rows, and rows without a doc_id, count each.

    The schedule is made from one row per size class, a number that does not grow with the groups; which groups of a class
    go where is settled by their rank in it. So sizes count as their class's mean, within 0.2 percent of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = frozen(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    placed = frozen(ranked(groups, "class", ("key",), "rank"))
    classes = placed.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # bounded, see size_class
    plan = [(name, [sum(counts[: s + 1]) for s in range(shards)]) for name, counts in schedule([tuple(r) for r in classes], shards)]
    plan = docs.sparkSession.createDataFrame(plan, "class long, ends array<long>")
    placed = placed.join(F.broadcast(plan), "class").select("key", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    return ranked(rows.join(placed, "key").drop("key"), "shard", ("doc_id", "text_crc32", "size"), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
