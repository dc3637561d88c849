"""Best-fit packing: whole documents into as few sequences as may be, by a linear program over the histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import configurations
from .common import stored, strings
from .sharding import ranked
from .tokens import WordBPE

SEQUENCE = 4096
#: Documents that a task holds at once as Python objects.
ROWS = 256


def _tokenise(path: str, sequence: int, end_id: int):
    """Pieces of documents: (row, doc_id, piece, start, length, ids), the ids with two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = WordBPE(path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        end = np.array([end_id], dtype=bpe.dtype)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                doc, piece, ids = [], [], []
                for d, text in enumerate(strings(some.column(1))):
                    own = np.concatenate((bpe.ids(text), end))
                    for k in range(-(-len(own) // sequence)):
                        doc.append(d)
                        piece.append(k)
                        ids.append(own[k * sequence : (k + 1) * sequence])
                piece = np.array(piece, dtype=np.int64)
                length = np.array([len(x) for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(ids))), some.column(0).take(pa.array(doc, pa.int64())), *map(pa.array, (piece, piece * sequence, length)), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["row", "doc_id", "piece", "start", "length", "ids"],
                )
                row += len(ids)

    return run


def _slots(plan: list[tuple[configurations.Configuration, int]]) -> np.ndarray:
    """The plan as rows (length, first rank, first sequence, pieces of that length in a sequence, their place), sorted: the
    pieces of a length go by their rank, one sequence after another, into the configurations that hold this length."""
    rows, ranks, sequence = [], {}, 0
    for configuration, n in plan:
        place = 0
        for length, pieces in configuration.items():
            rows.append((length, ranks.get(length, 0), sequence, pieces, place))
            ranks[length] = ranks.get(length, 0) + n * pieces
            place += length * pieces
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    """(row, sequence_id, offset) from (row, length, rank)."""
    # Ranks lie far below 2**48, lengths within 13 bits.
    keys = slots[:, 0] << 48 | slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, first, sequence, pieces, place = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            round_, within = np.divmod(rank - first, pieces)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, (sequence + round_, place + within * length))], names=["row", "sequence_id", "offset"])

    return run


def _widen(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                ids = [np.frombuffer(x.as_buffer(), dtype=dtype).astype("<u4").tobytes() for x in some.column("ids")]
                yield some.set_column(some.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))

    return run


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.

    A document is its ids under the vocabulary file, then `end_id`; a null text has that id alone. Only documents of over
    `sequence` tokens are cut, each `sequence` tokens; all pieces go into as few sequences as the plan needs. Equal lengths
    are dealt by doc_id, piece and row; repeated rows, and rows without a doc_id, are documents of their own. An empty table
    gives no pieces; other columns are left out.

    The plan is made by the driver from the histogram, one number for each length, and has at most some ten thousand rows
    for any number of documents (`configurations`). A range sort over length and doc_id ranks the pieces of a length, so a
    length that many share spreads over partitions; texts are tokenised once and kept as 2-byte ids in the shared folder.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenise(vocabulary, sequence, end_id), f"row long, doc_id {kind}, piece long, start long, length long, ids binary"))
    histogram = {r["length"]: r["count"] for r in tokens.groupBy("length").count().collect()}  # at most `sequence` rows
    plan, _ = configurations.plan(histogram, sequence)
    places = ranked(tokens.select("row", "doc_id", "piece", "length"), "length", ("doc_id", "piece", "row"), "rank")
    placed = places.select("row", "length", "rank").mapInArrow(_place(_slots(plan)), "row long, sequence_id long, offset long")
    joined = tokens.join(placed.hint("shuffle_hash"), "row").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
    return joined.mapInArrow(_widen(WordBPE.DTYPE), joined.schema)
