"""Feedback on findings: validation and the noise report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS, VERDICTS = ("lint", "llm"), ("up", "down")
# Known versions of the rule set.
VERSIONS = ("1.0.0", "1.1.0", "1.2.0")


def noise_report(rows: DataFrame, since: str | None = None) -> DataFrame:
    """(kind, key, up, down, total, down_rate) of votes (kind, key, verdict, created_at); `since` compares ISO texts. The
    rate is rounded to three places for output; the order goes by the raw one, then by total, kind and key."""
    if since is not None:
        rows = rows.where(F.col("created_at") >= since)
    made = rows.groupBy("kind", "key").agg(F.count_if(F.col("verdict") == "up").alias("up"), F.count_if(F.col("verdict") == "down").alias("down"), F.count("*").alias("total"))
    raw = F.col("down") / F.col("total")
    return made.withColumn("down_rate", F.round(raw, 3)).orderBy(F.desc(raw), F.desc("total"), "kind", "key")


def problem(kind: Column, key: Column, verdict: Column, profile: Column, version: Column, rules: list[str], themes: list[str], versions: tuple[str, ...] = VERSIONS) -> Column:
    """The first thing that is wrong with a vote, or null."""
    return (
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind")
        .when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "verdict")
        .when(~F.coalesce(F.when(kind == "lint", key.isin(*rules)).otherwise(key.isin(*themes)), F.lit(False)), "key")
        .when(profile.isNotNull() & ~profile.isin("default", "strict_law"), "profile")
        .when(version.isNotNull() & ~version.isin(*versions), "version")
    )


def accepted(rows: DataFrame, rules: list[str], themes: list[str]) -> DataFrame:
    """Valid votes only, with the columns that are stored."""
    error = problem(*[F.col(c) for c in ("kind", "key", "verdict", "profile", "ruleset_version")], rules, themes)
    return rows.where(error.isNull()).select("created_at", "kind", "key", "verdict", "ruleset_version", "profile")
