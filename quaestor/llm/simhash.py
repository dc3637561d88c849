"""SimHash fingerprints and near-duplicate classes by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen
from .components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Members of a block's bucket that one task compares at once; larger buckets are compared tile by tile.
TILE = 8192
#: Shingles whose hashes are held at once.
SLICE = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits: bit i is 1 if over half of the shingles' hashes have it. Words are runs of non-blank characters of the
    text with A-Z lower-cased; a text of fewer words than a shingle is one shingle, one without words has fingerprint 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, SLICE):
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts[k : k + SLICE], ends[k : k + SLICE])])
        votes += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: tuple[int, ...] = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks, as signed longs, of all choices of blocks that a close pair can agree on: with `radius` differing bits at
    most that many of the blocks differ, so each close pair agrees on one of the masks at least."""
    shifts = np.cumsum((0, *blocks))
    single = [((1 << size) - 1) << int(shift) for size, shift in zip(blocks, shifts)]
    masks = [sum(chosen) for chosen in combinations(single, len(blocks) - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links (i, js) that connect all of `fps` that are connected by steps of at most `radius` bits: a search that
    compares each one only with those that are not yet reached."""
    left, stack = np.arange(len(fps)), []
    while len(left) or stack:
        if not stack:
            stack, left = [int(left[0])], left[1:]
        i = stack.pop()
        near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
        if near.any():
            yield i, left[near]
            stack += left[near].tolist()
            left = left[~near]


def _links(run: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int, small: int = 12) -> list[np.ndarray]:
    """Verified links between members of equal `run` (sorted): all pairs in small runs, a spanning forest in others."""
    if not len(run):
        return []
    lengths = np.diff(np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True]))))
    starts = np.cumsum(lengths) - lengths
    out = []
    few = np.repeat(lengths <= small, lengths)
    for d in range(1, min(small, int(lengths.max()))):
        i = np.flatnonzero((run[d:] == run[:-d]) & few[:-d])
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        out.append(np.stack([reps[i], reps[i + d]]))
    for s, n in zip(starts[lengths > small], lengths[lengths > small]):
        for i, js in _forest(fps[s : s + n], radius):
            out.append(np.stack([np.full(len(js), reps[s + i]), reps[s + js]]))
    return out


_LINKED = "a long, b long, bucket long, fp long, rep long"


def _link_buckets(radius: int, most: int | None):
    """For rows (bucket, fp, rep) sorted by bucket: links (a, b) found in it; the members of buckets of over `most` rows
    come back as they are, with null links."""

    def rows(data: np.ndarray, linked: bool) -> pa.RecordBatch:
        none = [pa.nulls(data.shape[1], pa.int64())] * (3 if linked else 2)
        data = [pa.array(x) for x in data]
        return pa.RecordBatch.from_arrays([*data, *none] if linked else [*none, *data], names=["a", "b", "bucket", "fp", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((3, 0), dtype=np.int64)  # the bucket that may go on in the next batch
        over = None  # the bucket that was too large, of which more may come
        for batch in chain(batches, [None]):
            cut = kept.shape[1]
            if batch is not None:
                kept = np.concatenate([kept, [x.to_numpy() for x in batch.columns]], axis=1)
                if over is not None:
                    n = int(np.searchsorted(kept[0], over, side="right"))
                    yield rows(kept[:, :n], False)
                    kept = kept[:, n:]
                if not kept.shape[1]:
                    continue
                over, cut = None, int(np.searchsorted(kept[0], kept[0, -1]))
            whole, kept = kept[:, :cut], kept[:, cut:]
            lengths = np.diff(np.flatnonzero(np.concatenate(([True], whole[0, 1:] != whole[0, :-1], [True])))) if cut else np.zeros(0, dtype=np.int64)
            if most is not None and (lengths > most).any():
                large = np.repeat(lengths > most, lengths)
                yield rows(whole[:, large], False)
                whole = whole[:, ~large]
            if links := _links(whole[0], whole[1].view(np.uint64), whole[2], radius):
                yield rows(np.concatenate(links, axis=1), True)
            if most is not None and kept.shape[1] > most:
                yield rows(kept, False)
                over, kept = int(kept[0, 0]), kept[:, :0]

    return run


def close_links(points: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, tile: int = TILE) -> DataFrame:
    """For distinct fingerprints (fp long, rep long): links (a, b) between `rep`s such that two fingerprints are connected
    by the links exactly if they are by steps of at most `radius` differing bits.

    Each fingerprint goes to one bucket for each choice of len(blocks) - radius blocks; buckets are made by one shuffle
    and one sort, and read as runs. (A bucket's key is a hash: buckets that share one are compared, no more.) Buckets of
    over `tile` members are split: each two of their tiles meet in one task.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask")) for i, m in enumerate(block_masks(blocks, radius))])
    keyed = points.select("fp", "rep", F.explode(masks).alias("m")).select(F.xxhash64("m.i", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("bucket"), "fp", "rep")
    found = frozen(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_buckets(radius, tile), _LINKED))
    links, big = found.where("a is not null").select("a", "b"), found.where("a is null").select("bucket", "fp", "rep")
    if big.isEmpty():
        return links
    tiles = big.groupBy("bucket").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / F.lit(tile / 2))).cast("int").alias("n"))
    mine = big.join(tiles, "bucket").withColumn("x", F.pmod(F.xxhash64("fp"), "n").cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("x <> y")
    pairs = mine.select(F.xxhash64("bucket", F.least("x", "y"), F.greatest("x", "y")).alias("bucket"), "fp", "rep")
    return links.union(pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link_buckets(radius, None), _LINKED).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): documents are linked if their fingerprints differ in at most `radius` bits; the
    component is the smallest doc_id that links reach, its own included.

    Rows of one fingerprint are one point from the start, so copies never make pairs. Rows without a doc_id are kept;
    they take the component of their fingerprint's other rows, or null. An empty table gives an empty table.
    """
    prints = frozen(with_fingerprints(docs))
    points = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(close_links(points.where("rep is not null"), radius, tile=tile))
    classes = points.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def point_links(texts: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """For texts (point long, text), a text's copies under its own point: links (a, b) that connect all points whose
    fingerprints are connected by steps of at most `radius` bits."""
    prints = frozen(with_fingerprints(texts.select(F.col("point").alias("doc_id"), "text")).distinct())
    heads = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    equal = prints.join(heads, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return equal.union(close_links(heads, radius, tile=tile))


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
