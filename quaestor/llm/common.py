"""What several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as the session names it. Only a local session, whose executors are the
    driver itself, may leave it unset; then it is a folder of this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def drop_stored(spark: SparkSession) -> None:
    """Deletes the checkpoints and stored tables that this session has made so far; results that still read them must have
    been written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frozen(df: DataFrame) -> DataFrame:
    """Computes `df` once and cuts its lineage with a reliable checkpoint; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `frozen`, but as a Parquet table beside the checkpoints, so that readers can prune columns."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small row groups: a task buffers one
    return df.sparkSession.read.parquet(path)


def crc_mod(key: str, modulus: int) -> Column:
    """crc32 of a key's text, modulo a number: the split between learning and held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, key: str, bound: int, salt: str = "sample", n: int | None = None) -> DataFrame:
    """About `bound` rows of `df` at most, chosen by a hash of the whole row, its `key` and salt first; all rows if there are
    no more than that. Only rows that are equal in all columns go in or out together. `n` is the number of rows, if known."""
    n = df.count() if n is None else n
    if n <= bound:
        return df
    parts = 1 << 53
    rest = [f"`{c}`" for c in df.columns if c != key]
    return df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key), *rest), F.lit(parts)) < int(parts * bound / n))


def text_slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Cuts a list of texts into runs of whole texts with about `most` characters each."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """An Arrow column as Python strings; null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
