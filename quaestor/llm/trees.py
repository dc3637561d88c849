"""Decision trees of pyspark.ml as plain nested tuples, and as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a number; a node is (feature, threshold, tree if feature <= threshold, tree otherwise).
Tree = float | tuple


def read_tree(debug: str) -> Tree:
    """Reads what `toDebugString` of a tree over continuous features prints."""
    lines = iter(x.strip() for x in debug.splitlines()[1:] if x.strip())

    def node() -> Tree:
        line = next(lines)
        if m := re.match(r"Predict: (\S+)", line):
            return float(m[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        next(lines)  # Else
        return int(m[1]), float(m[2]), left, node()

    return node()


def as_column(tree: Tree, feature: Callable[[int], Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    k, threshold, left, right = tree
    return F.when(feature(k) <= threshold, as_column(left, feature)).otherwise(as_column(right, feature))


def as_sql(tree: Tree, feature: Callable[[int], str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    k, threshold, left, right = tree
    return f"CASE WHEN {feature(k)} <= {threshold!r}D THEN {as_sql(left, feature)} ELSE {as_sql(right, feature)} END"


def paths(tree: Tree, before: tuple = ()) -> Iterator[tuple]:
    """Each inner and leaf node but the root as its conditions (feature, threshold, whether it is at most that)."""
    if before:
        yield before
    if isinstance(tree, tuple):
        k, threshold, left, right = tree
        yield from paths(left, (*before, (k, threshold, True)))
        yield from paths(right, (*before, (k, threshold, False)))
