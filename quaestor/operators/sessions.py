"""Sessions, caps, rates and first events, over tables of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, ts: str, gap: str = "1 hour") -> DataFrame:
    """(user, session_start, session_end, n): events of a user at most a gap apart."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def rate_hits(events: DataFrame, client: str, route: str, ts: str, limits: dict[str, int], default: int, width: str = "1 minute") -> DataFrame:
    """(client, route, minute, n, n_over) where a client passes a route's limit in a window."""
    limit = F.lit(default)
    for name, n in limits.items():
        limit = F.when(F.col(route) == name, n).otherwise(limit)
    counts = events.groupBy(client, route, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(client, route, F.col("w.start").alias("minute"), "n", (F.col("n") - limit).alias("n_over"))


def newest(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """The `cap` newest rows: a limit of the feature, so each partition sends no more than that."""
    return rows.orderBy(*order).limit(cap)


def first_of(events: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first event for each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def progress(events: DataFrame, key: str, order: list) -> DataFrame:
    """Events with `done`, the number of a key's events so far."""
    return events.withColumn("done", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
