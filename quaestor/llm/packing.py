"""Packing of documents into token sequences along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, stored, strings
from .tokens import ByteBPE

SEQUENCE = 2048
#: Buckets of a document's hashed vector, dimensions it is projected to, and bits of each on the curve.
BUCKETS, DIMENSIONS, BITS = 1024, 3, 16
#: Documents that a task holds at once as Python objects.
ROWS = 256


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of integers below 2**bits (Skilling, 2004)."""
    x = points.T.astype(np.int64)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] >> b & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = key << 1 | x[i] >> b & 1
    return key


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = ByteBPE(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        axes = np.random.default_rng(7).standard_normal((BUCKETS, DIMENSIONS))
        end = np.array([end_id], dtype=bpe.dtype)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                b = min(a + ROWS, len(batch))
                ids = [np.concatenate((bpe.ids(t), end)) for t in strings(batch.column(1).slice(a, b - a))]
                # A vector of root counts in hashed buckets, of unit length.
                counts = np.sqrt([np.bincount(x.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22), minlength=BUCKETS) for x in ids])
                points = (counts / np.linalg.norm(counts, axis=1, keepdims=True)) @ axes
                rows = pa.array(np.arange(row, row + b - a))
                row += b - a
                yield pa.RecordBatch.from_arrays(
                    [rows, batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *map(pa.array, points.T)],
                    names=["row", "doc_id", "n", "ids", *(f"x{i}" for i in range(DIMENSIONS))],
                )

    return run


def _along_curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n, key) from standardised coordinates."""
    for batch in batches:
        z = np.stack([batch.column(f"x{i}").to_numpy() for i in range(DIMENSIONS)], axis=1)
        place = np.clip((1 << BITS) / (1 + np.exp(-1.702 * np.clip(z, -9, 9))), 0, (1 << BITS) - 1)  # near-uniform
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n"), pa.array(hilbert_key(place.astype(np.int64), BITS))], names=["row", "doc_id", "n", "key"])


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, part, before, n): the tokens before each row in its partition."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        sums = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, dtype=np.int64)), pa.array(sums - n), batch.column("n")], names=["row", "part", "before", "n"])
        total = int(sums[-1]) if len(n) else total


def _cut(sequence: int, dtype: str):
    """Pieces of documents (doc_id, ids, place): a document is cut where a sequence ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                n, place = some.column("n").to_numpy(), some.column("place").to_numpy()
                first = place // sequence
                pieces = (place + n - 1) // sequence - first + 1
                doc = np.repeat(np.arange(len(n)), pieces)
                number = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.maximum(number * sequence, place[doc])
                stop = np.minimum((number + 1) * sequence, (place + n)[doc])
                ids = [np.frombuffer(x.as_buffer(), dtype=dtype).astype("<u4") for x in some.column("ids")]
                out = [ids[d][s:e].tobytes() for d, s, e in zip(doc.tolist(), (start - place[doc]).tolist(), (stop - place[doc]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(doc)), *map(pa.array, (start - place[doc], stop - start)), pa.array(out, pa.binary()), *map(pa.array, (n[doc], number, start - number * sequence))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids under the vocabulary file, then `end_id`; a null text has that id alone. Its hashed token vector
    is projected to a few dimensions, standardised over all documents, and put on a Hilbert curve; documents follow each
    other along the curve, ties by doc_id, and are cut at each `sequence` tokens. So all sequences are full but the last.
    Repeated rows, and rows without a doc_id, are documents of their own. An empty table gives no pieces.

    Texts are tokenised once and kept as 2-byte ids in the shared folder; only narrow rows are sorted. The range sort
    takes doc_id and row with the key, so that a group of equal documents spreads over partitions; sums over partitions
    make places of the places within them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenise(vocabulary, end_id), f"row long, doc_id {kind}, n long, ids binary, {', '.join(f'{x} double' for x in axes)}"))
    spread = tokens.agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(x) for x in axes]).first()
    scaled = [((F.col(x) - F.lit(spread[x]["m"] or 0.0)) / F.lit(max(spread[x]["s"] or 0.0, 1e-9))).alias(x) for x in axes]
    keyed = tokens.select("row", "doc_id", "n", *scaled).mapInArrow(_along_curve, f"row long, doc_id {kind}, n long, key long")
    order = ("key", "doc_id", "row")
    sorted_rows = frozen(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running, "row long, part long, before long, n long"))
    # One row per partition.
    starts = sorted_rows.groupBy("part").agg(F.sum("n").alias("own")).withColumn("base", F.sum("own").over(Window.orderBy("part")) - F.col("own"))
    placed = sorted_rows.join(F.broadcast(starts), "part").select("row", (F.col("base") + F.col("before")).alias("place"))
    joined = tokens.select("row", "doc_id", "n", "ids").join(placed.hint("shuffle_hash"), "row")
    dtype = ByteBPE(vocabulary).dtype.str
    return joined.select("doc_id", "n", "ids", "place").mapInArrow(
        _cut(sequence, dtype), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
