"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, frozen
from .quality import STATISTICS, with_statistics
from .trees import paths, read_tree

#: Labelled rows that the ensemble is fitted on, at most about.
TRAINING_ROWS = 50_000
TREES, DEPTH, LEAST_ROWS = 15, 3, 5
#: Weight of the absolute sum of the rules' weights.
LASSO = 0.002
#: The statistics that rules are about, from the columns of STATISTICS and a few more of the text.
VARIABLES = {
    "words": lambda: F.col("n_words"),
    "word_length": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbol_share": lambda: F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines"),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "capital_share": lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    "digit_share": lambda: F.col("n_digits") / F.greatest("word_chars", F.lit(1)),
    "exclamation_share": lambda: F.col("n_exclamations") / F.greatest("word_chars", F.lit(1)),
    "line_words": lambda: F.col("n_words") / (F.col("n_breaks") + 1),
}
Conditions = tuple[tuple[str, float, bool], ...]


@dataclass
class RuleEnsemble:
    """A logistic model: each rule is a conjunction of (variable, threshold, whether it is at most that) with a weight."""

    intercept: float = 0.0
    rules: list[tuple[float, Conditions]] = field(default_factory=list)

    def score(self) -> Column:
        """The ensemble as one column expression over the VARIABLES."""
        total = sum((F.when(_holds(c), F.lit(w)).otherwise(0.0) for w, c in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def _holds(conditions: Conditions) -> Column:
    return reduce(lambda a, b: a & b, [F.col(v) <= t if low else F.col(v) > t for v, t, low in conditions])


def _tightest(path: tuple) -> Conditions:
    """A tree path's conditions, of those on one variable and side the tightest."""
    found: dict[tuple[int, bool], float] = {}
    for k, t, low in path:
        before = found.get((k, low), t)
        found[k, low] = min(t, before) if low else max(t, before)
    names = list(VARIABLES)
    return tuple((names[k], t, low) for (k, low), t in sorted(found.items()))


def with_variables(docs: DataFrame) -> DataFrame:
    """(doc_id, the VARIABLES as doubles) of each document's whole text; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    rows = with_statistics(docs.select("doc_id", "text")).select(
        "doc_id", *STATISTICS, less(r"\p{Lu}+").alias("n_capitals"), less("[0-9]+").alias("n_digits"), less("!+").alias("n_exclamations"), less("\n+").alias("n_breaks")
    )
    return rows.select("doc_id", *[f().cast("double").alias(v) for v, f in VARIABLES.items()])


def fit(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learns from (doc_id, VARIABLES, label 0 or 1): the nodes of a small random forest are the rules, and a logistic
    regression with a lasso penalty weights them; rules of weight 0 go. At most about `rows` rows are used, chosen by a hash
    of doc_id. With one label only, or none, the score is the (smoothed) share of label 1, or 0.5."""
    data = bounded_sample(labelled.where("label is not null"), "doc_id", rows).select(F.col("label").cast("double").alias("label"), *VARIABLES)
    data = frozen(data.coalesce(4))
    counts = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
    if set(counts) != {0.0, 1.0}:
        return RuleEnsemble(math.log((counts.get(1.0, 0) + 1) / (counts.get(0.0, 0) + 1)))
    vectors = data.select("label", array_to_vector(F.array(*VARIABLES)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=LEAST_ROWS, subsamplingRate=0.7, seed=3).fit(vectors)
    rules = list(dict.fromkeys(_tightest(p) for t in forest.trees for p in paths(read_tree(t.toDebugString))))
    if not rules:
        return RuleEnsemble(math.log((counts[1.0] + 1) / (counts[0.0] + 1)))
    fired = frozen(data.select("label", array_to_vector(F.array(*[_holds(r).cast("double") for r in rules])).alias("features")))
    weights = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60).fit(fired)
    return RuleEnsemble(float(weights.intercept), [(float(w), r) for w, r in zip(weights.coefficients.toArray(), rules) if abs(w) > 1e-6])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, score) for each document: the probability of quality 1. Labels (doc_id, quality) are used where `learn`, a
    condition on doc_id, holds; repeated labels of a doc_id count by their largest, null ones not at all. Repeated rows
    and rows without a doc_id are scored each; no rows give no rows."""
    stats = frozen(with_variables(docs))
    known = labels.where(learn).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(stats.dropDuplicates(["doc_id"]).join(known, "doc_id"), bound)
    return stats.select("doc_id", model.score().alias("score"))
