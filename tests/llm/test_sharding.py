import heapq
import random
import zlib
from collections import defaultdict

import pytest

from quaestor.llm import sharding

SCHEMA = "doc_id long, text string, key string, size string, shard string, slot string"


def plain_loads(sizes, shards):
    heap = [0] * shards
    for s in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    return sorted(heap)


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_the_plain_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 900, rng.randint(1, 1000)]) for _ in range(rng.choice([3, 100, 5000]))] + [4000] * (seed % 2)
    classes = [(s, sizes.count(s), s * sizes.count(s)) for s in set(sizes)]
    plan = sharding.schedule(classes, 7)
    assert all(sum(c) == n for (_, c), (_, n, _) in zip(plan, sorted(classes, reverse=True)))
    assert sorted(sum(s * c[k] for s, c in plan) for k in range(7)) == plain_loads(sizes, 7)


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r.size].add(r.shard)
        assert 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in of.values())


def test_whole_tables(spark):
    rng = random.Random(9)
    texts = [None, "", *("x" * rng.choice([3, 50, rng.randint(1, 700)]) + rng.choice(["", "é", "y", "z"]) for _ in range(900)), *["hot copy"] * 500]
    rows = [(i, t, "clash", "1", "1", "1") for i, t in enumerate(texts)] + [(5, texts[5], None, None, None, None), (None, "no id", None, None, None, None), (None, None, None, None, None, None)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(3), 5).collect()
    check(rows, got, 5)
    loads, groups = defaultdict(int), defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
        groups[r.text_crc32, r.size] += r.size
    largest = max(groups.values())
    assert max(loads.values()) <= max(largest, 1.02 * sum(loads.values()) / 5)


def test_few_and_no_rows(spark):
    rows = [(1, "a", None, None, None, None), (2, "bb", None, None, None, None)]
    check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA), 16).collect(), 16)
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 16).collect() == []
