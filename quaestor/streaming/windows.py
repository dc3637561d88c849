"""The streaming forms of sessions, rates and first events: keyed state behind watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files. Times without a zone are read in the session's, as watermarks need one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c) for c, kind in rows.dtypes])


def stream_sessions(events: DataFrame, user: str, ts: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """As sessions.sessions; a session is final, and its state goes, when the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stream_rates(events: DataFrame, client: str, route: str, ts: str, limit: int, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    counts = events.withWatermark(ts, late).groupBy(client, route, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(client, route, F.col("w.start").alias("minute"), "n")


def stream_first(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's reach."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to Parquet, and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
