"""Field samples and schema violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse


def leaf_paths(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of a type's leaves, with [] for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in leaf_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, f"{path}[]")
    return [path]


def values_at(path: str) -> Column:
    """All values at a path as an array of texts; arrays fan out."""
    head, *rest = path.split(".")
    start: Column = F.col(f"`{head.removesuffix('[]')}`")
    start = start if head.endswith("[]") else F.array(start)
    for part in rest:
        name, many = part.removesuffix("[]"), part.endswith("[]")
        start = F.transform(start, _field(name))
        start = F.flatten(F.filter(start, lambda x: x.isNotNull())) if many else start
    return F.filter(F.transform(start, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != ""))


def _field(name: str):
    return lambda x: x[name]


def cut(value: Column, most: int = 800) -> Column:
    clean = collapse(value)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("..."))).otherwise(clean)


def first_distinct(rows: DataFrame, field: str, value: str, order: list[str], n: int = 3) -> DataFrame:
    """(field, value, source order..., place): of each field, the first n distinct values."""
    first = rows.groupBy(field, value).agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(Window.partitionBy(field).orderBy("_at", value))
    return first.withColumn("place", place).where(F.col("place") <= n).select(field, value, "_at.*", "place")


def field_samples(protocols: DataFrame, paths: list[str], n: int = 3, source: str = "protocol_id") -> DataFrame:
    """(path, value, source, place) for paths of the canonical protocol: one scan, then n values of each path."""
    entries = F.flatten(F.array(*[F.transform(values_at(p), _entry(p)) for p in paths]))
    rows = protocols.select(F.col(source), F.explode(entries).alias("x")).select(source, "x.path", cut(F.col("x.value")).alias("value"))
    return first_distinct(rows, "path", "value", [source], n)


def _entry(path: str):
    return lambda v: F.struct(F.lit(path).alias("path"), v.alias("value"))


#: Constraints on protocols: (path, rule, whether a value violates it).
CONSTRAINTS: dict[tuple[str, str], object] = {
    ("research.request_type", "enum"): lambda: F.col("research.request_type").isNotNull() & ~F.col("research.request_type").isin("regular", "pilot"),
    ("research.approval_term_years", "minimum"): lambda: F.col("research.approval_term_years") < 1,
    ("animals_total[].n_total", "minimum"): lambda: F.exists("animals_total", lambda t: t["n_total"] < 0),
    ("experiments[].severity_level_1_to_5", "range"): lambda: F.exists("experiments", lambda e: ~e["severity_level_1_to_5"].between(1, 5)),
    ("experiments[].animals.n", "minimum"): lambda: F.exists("experiments", lambda e: e["animals"]["n"] < 0),
    ("experiments[].animals.sex", "enum"): lambda: F.exists("experiments", lambda e: ~e["animals"]["sex"].isin("M", "F", "both", "male", "female", "unknown")),
}


def violations(protocols: DataFrame, limit: int = 20) -> DataFrame:
    """(protocol_id, path, rule): at most `limit` violations of a protocol, by path; the offending value is never shown."""
    found = [F.when(F.coalesce(test(), F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"))) for (p, r), test in CONSTRAINTS.items()]
    missing = F.transform("missing_keys", lambda k: F.struct(k.alias("path"), F.lit("required").alias("rule")))
    whole = F.slice(F.array_sort(F.concat(missing, F.filter(F.array(*found), lambda x: x.isNotNull()))), 1, limit)
    return protocols.select("protocol_id", F.inline(whole))


def conformance(found: DataFrame) -> DataFrame:
    """(path, rule, protocols)."""
    return found.groupBy("path", "rule").agg(F.count_distinct("protocol_id").alias("protocols"))
