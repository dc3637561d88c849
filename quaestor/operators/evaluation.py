"""Metrics of graded pairs and repeats, and checks of golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_scores(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last one's score, json_ok, citations and seconds."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in ("score", "json_ok", "citations", "seconds")])


def pair_metrics(rows: DataFrame, keys: list[str], order: str, by: list[str], condition: str = "condition") -> DataFrame:
    """Metrics of graded rows for each condition, and for each condition and value of `by`, in one pass by grouping sets
    (columns of `by` are null in the first kind): calls; json_ok; n_pairs, the (keys) with a score of both variants; of these
    pair_acc, where good is above bad; bad_hit, bad rows scored 1 or less; good_clean, good rows scored 2 or more; gap, the
    difference of mean scores; cited, for grounded rows only; sec. Of repeated rows of a key and variant, the last one's
    score makes the pair. What has no rows is null."""
    paired = rows.groupBy(condition, *by, *keys).agg(*[F.max_by("score", F.when(F.col("variant") == v, F.col(order))).alias(v) for v in ("good", "bad")])
    full = F.col("good").isNotNull() & F.col("bad").isNotNull()
    sets = [(condition,), (condition, *by)] if by else [(condition,)]
    grouped = lambda df: df.groupingSets([[F.col(c) for c in s] for s in sets], condition, *by)
    of = lambda v, test: F.avg(F.when((F.col("variant") == v) & F.col("score").isNotNull(), test.cast("double")))
    a = grouped(rows).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("calls"), F.avg(F.col("json_ok").cast("double")).alias("json_ok"), of("bad", F.col("score") <= 1).alias("bad_hit"), of("good", F.col("score") >= 2).alias("good_clean"),
        (of("good", F.col("score")) - of("bad", F.col("score"))).alias("gap"), F.avg(F.when(F.col(condition) == "grounded", (F.col("citations") > 0).cast("double"))).alias("cited"), F.avg("seconds").alias("sec"),
    )
    b = grouped(paired).agg(F.grouping_id().alias("_g"), F.count_if(full).alias("n_pairs"), F.avg(F.when(full, (F.col("bad") < F.col("good")).cast("double"))).alias("pair_acc"))
    names = [condition, *by, "_g"]
    b = b.select(*[F.col(c).alias(f"_{c}") for c in names], "n_pairs", "pair_acc")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return a.join(b, same).select(condition, *by, "calls", "json_ok", "n_pairs", "pair_acc", "bad_hit", "good_clean", "gap", "cited", "sec")


def flip_rate(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, parse_fail, no_score, groups, flips, flip_rate, mean_score): a set of repeats flips if its scores differ;
    only sets with two scores at least count."""
    each = rows.groupBy(group, *keys).agg(F.count_distinct("score").alias("kinds"), F.count("score").alias("scores"))
    flips = each.where("scores >= 2").groupBy(group).agg(F.count("*").alias("groups"), F.count_if(F.col("kinds") > 1).alias("flips"))
    plain = rows.groupBy(group).agg(F.avg((~F.col("parse_ok")).cast("double")).alias("parse_fail"), F.avg(F.col("score").isNull().cast("double")).alias("no_score"), F.avg("score").alias("mean_score"))
    return plain.join(flips, group, "left").withColumn("flip_rate", F.col("flips") / F.col("groups"))


def expected_against_actual(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, missing, extra, exact) for sorted lists of references."""
    both = expected.withColumnRenamed("refs", "_want").join(actual.withColumnRenamed("refs", "_got"), key, "left").withColumn("_got", F.coalesce("_got", F.array().cast("array<string>")))
    return both.select(key, F.array_sort(F.array_except("_want", "_got")).alias("missing"), F.array_sort(F.array_except("_got", "_want")).alias("extra"), (F.array_sort("_want") == F.array_sort("_got")).alias("exact"))


def unknown_values(cases: DataFrame, key: str, column: str, known: DataFrame, value: str) -> DataFrame:
    """(key, field, value): values of an array column that the dimension does not have."""
    rows = cases.select(key, F.explode(column).alias("value"))
    return rows.join(known.select(F.col(value).alias("value")), "value", "left_anti").select(key, F.lit(column).alias("field"), "value")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not in the log yet."""
    return work.join(done, keys, "left_anti")


def citations(text: str):
    """How many references [G1], [G2], ... a text has."""
    return F.regexp_count(F.col(text), F.lit(r"\[G\d+\]"))
