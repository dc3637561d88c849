"""Totals against details: sums of experiments compared with declared totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..plans.spec import CHECK, finding, let

KEYS = ("species", "strain", "sex", "genetic_status")


def simplified(totals: DataFrame, key: str = "protocol_id") -> DataFrame:
    """(key, simplified): whether any of the totals lacks strain and genetic status, or lists several strains."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rough = (empty("strain") & empty("genetic_status")) | F.coalesce(F.col("strain").contains(","), F.lit(False))
    return totals.groupBy(key).agg(F.bool_or(rough).alias("simplified"))


def strict_mismatches(totals: DataFrame, details: DataFrame, key: str = "protocol_id") -> DataFrame:
    """Rows of totals (key, KEYS, n_total) whose sum of details (key, KEYS, n) differs; details with a null key part don't
    count, and groups without totals are not reported."""
    known = details.where(F.greatest(*[F.col(k).isNull().cast("int") for k in KEYS]) == 0)
    sums = known.groupBy(key, *KEYS).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_details"))
    same = [totals[k].eqNullSafe(sums[k]) for k in (key, *KEYS)]
    both = totals.join(sums, same, "left").select(*[totals[c] for c in (key, *KEYS)], F.coalesce(totals["n_total"], F.lit(0)).cast("long").alias("n_total"), F.coalesce(sums["n_details"], F.lit(0)).cast("long").alias("n_details"))
    return both.where("n_total <> n_details")


def simplified_mismatches(totals: DataFrame, details: DataFrame, key: str = "protocol_id") -> DataFrame:
    """Species whose sums differ, those that only one side has included; species are stripped, not lower-cased."""
    species = F.trim(F.coalesce("species", F.lit(""))).alias("species")
    a = totals.groupBy(key, species).agg(F.sum(F.coalesce("n_total", F.lit(0))).cast("long").alias("n_total"))
    known = details.where(F.greatest(*[F.col(k).isNull().cast("int") for k in KEYS]) == 0)
    b = known.groupBy(key, species).agg(F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("n_details"))
    both = a.join(b, [key, "species"], "full").select(key, "species", F.coalesce("n_total", F.lit(0)).alias("n_total"), F.coalesce("n_details", F.lit(0)).alias("n_details"))
    return both.where("n_total <> n_details")


def totals_finding(totals: Column, exps: Column) -> Column:
    """Within a protocol's row: an array of one finding if it has totals, else of none. It fails if any row mismatches, by the
    mode that the totals call for; both modes are those of `strict_mismatches` and `simplified_mismatches`."""
    total = lambda rows, n: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[n], F.lit(0)))
    line = lambda name, n, m: F.concat(F.trim(name), F.lit(": total "), n.cast("string"), F.lit(", experiments "), m.cast("string"))
    known = F.filter(F.transform(exps, lambda x: F.struct(*[x["e"]["animals"][k].alias(k) for k in (*KEYS, "n")])), lambda d: reduce(lambda a, b: a & b, [d[k].isNotNull() for k in KEYS]))
    rough = F.exists(totals, lambda t: ((text(t["strain"]) == "") & (text(t["genetic_status"]) == "")) | F.coalesce(t["strain"].contains(","), F.lit(False)))

    def strict(details: Column) -> Column:
        def one(t: Column) -> Column:
            n, m = F.coalesce(t["n_total"], F.lit(0)), total(F.filter(details, lambda d: reduce(lambda a, b: a & b, [d[k].eqNullSafe(t[k]) for k in KEYS])), "n")
            return F.when(n != m, line(F.concat_ws(" ", *[t[k] for k in KEYS]), n, m))

        return F.transform(totals, one)

    def simple(details: Column) -> Column:
        name = lambda x: F.trim(text(x["species"]))
        kinds = F.array_distinct(F.concat(F.transform(totals, name), F.transform(details, name)))

        def one(k: Column) -> Column:
            n, m = total(F.filter(totals, lambda t: name(t) == k), "n_total"), total(F.filter(details, lambda d: name(d) == k), "n")
            return F.when(n != m, line(k, n, m))

        return F.transform(kinds, one)

    bad = let(known, lambda details: F.when(rough, simple(details)).otherwise(strict(details)))
    made = let(F.array_sort(F.filter(bad, lambda x: x.isNotNull())), lambda x: finding("animals:totals-vs-exps", F.lit((1 * 100 + 1) * 10**9), F.lit("animals:totals-vs-exps"), F.size(x) == 0, "E", F.array_join(x, "; ")))
    return F.when(F.coalesce(F.size(totals), F.lit(0)) > 0, F.array(made)).otherwise(F.array().cast(f"array<{CHECK}>"))


def backfill(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the distinct non-empty values of a group, sorted and joined."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col(value) != "", F.col(value)))), ", ").alias(value))
