"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For links (a long, b long): one row (node, component) for each node that has a link; the component is its
    smallest node. Links with a null end and links of a node to itself say nothing and are left out.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the links are stars around the
    smallest nodes. A round moves as many rows as there are links; minima are aggregated before the shuffle, and joins on
    a hub's key are left to adaptive skew handling. Each round is checkpointed, so lineage stays short.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, state = frozen(links), None
    for _ in range(most_rounds):
        # Large star: each larger neighbour of a node links to the smallest of the node and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours link to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = frozen(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # As decimals: a sum of hashes overflows a long.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links have not settled in {most_rounds} rounds")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
