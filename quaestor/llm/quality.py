"""Quality rules: text statistics, fixed rules, and robust multivariate outliers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen

Sized = Callable[[DataFrame], DataFrame]
BLANKS = r"[\x20\x09-\x0D]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Share of a group's rows that its estimates rest on, and the fewest rows of a group.
SUPPORT, LEAST_ROWS = 0.75, 50
#: Change of a log-determinant up to which a support set has settled, and steps after which a fit ends in any case.
SETTLED, MOST_STEPS = 1e-9, 100
#: Ways to start the concentration, see `_starts`.
STARTS = ("scaled", "signs", "bounded")
#: Quantiles of a grid by which an order statistic is bracketed, the sketches' accuracy, and the rows that a bracket may hold.
GRID, ACCURACY, BRACKET = 1000, 10_000, 20_000
#: Groups up to which their estimates (a row of some 200 bytes each) are sent to every task; beyond it, they are joined.
BROADCAST_GROUPS = 50_000
#: Probability that a good row, were it normal, is rejected by its distance.
TAIL = 1e-9
#: The coordinates of a statistic vector, and of each the deviation that is too small to matter: it is added to the
#: estimated one, so that a coordinate that is constant in nearly all rows does not turn any other value into an outlier.
COORDINATES = {
    "log_words": (lambda: F.log1p("n_words"), 1.0),
    "log_word_length": (lambda: F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), 0.1),
    "symbol_share": (lambda: F.col("n_symbols") / (F.col("word_chars") + 1), 0.01),
    "log_dup_lines": (lambda: F.log1p("n_dup_lines"), 0.7),
    "repeat_share": (lambda: F.col("n_repeat_words") / (F.col("n_words") + 1), 0.1),
}


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns of STATISTICS (long), which replace columns of these names; null texts count as empty.

    Words are runs of characters other than blanks. word_chars: code points in words; n_symbols: characters of
    [#*$%&|<>]; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in windows of three words
    that occur twice or more. All is worked out within a row: windows are compared by 64-bit hashes, and sorted only in
    texts in which one repeats.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in STATISTICS]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*kept, F.split(text, BLANKS, -1).alias("_parts"))
    rows = rows.select(*kept, (F.size("_parts") - 1).alias("_blanks"), F.transform(F.filter("_parts", lambda x: x != ""), lambda x: F.xxhash64(x)).alias("_words"))
    ahead = lambda k: F.slice("_words", k, F.greatest(F.size("_words") - 2, F.lit(0)))
    rows = rows.select(*kept, "_blanks", F.size("_words").alias("_n"), F.transform(F.arrays_zip(ahead(1).alias("a"), ahead(2).alias("b"), ahead(3).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("_windows"))
    by_hash = F.array_sort(F.transform("_windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.select(*kept, "_blanks", "_n", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), by_hash).alias("_sorted"))
    same = lambda k, x: F.coalesce(F.get("_sorted", k)["g"] == x["g"], F.lit(False))
    found = F.filter("_sorted", lambda x, k: same(k - 1, x) | same(k + 1, x))
    rows = rows.select(*kept, "_blanks", "_n", F.array_sort(F.transform(found, lambda x: x["i"])).alias("_at"))
    # The union of the windows: each adds three words, less what the one before it covers.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_at", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(*kept, "_blanks", "_n", covered.alias("_covered"), lines.alias("_lines"))
    return rows.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        (F.length(text) - F.col("_blanks")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce("_covered", F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def chi2_cdf(x: float, freedom: int) -> float:
    """By the recurrence over degrees of freedom."""
    value = math.erf(math.sqrt(x / 2)) if freedom % 2 else 1 - math.exp(-x / 2)
    for k in range(1 if freedom % 2 else 2, freedom, 2):
        value -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return value


def chi2_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, freedom) < p else (low, mid)
    return high


_KEYS = ["group", "start"]


def _estimates(rows: DataFrame, scale: float, own: list[float]) -> DataFrame:
    """For each group and start: the means m0.. of its rows, the Cholesky factor l00, l10.. of their covariance, which is
    scaled and widened by the coordinates' own deviations, the logarithm of the determinant, and `was`, if rows have it."""
    p = len(COORDINATES)
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]
    covariances = [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)]
    before = [F.max("was").alias("was")] if "was" in rows.columns else []
    found = rows.groupBy(*_KEYS).agg(*means, *covariances, *before)
    for j in range(p):  # column by column: the diagonal, then what is below it
        rest = [F.col(f"s{i}{j}") * scale + (own[i] ** 2 if i == j else 0.0) - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0)) for i in range(j, p)]
        found = found.withColumn(f"l{j}{j}", F.sqrt(rest[0]))
        found = found.withColumns({f"l{i}{j}": rest[i - j] / F.col(f"l{j}{j}") for i in range(j + 1, p)}) if j + 1 < p else found
    logs = [2 * F.log(f"l{i}{i}") for i in range(p)]
    return found.select(*_KEYS, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], sum(logs[1:], logs[0]).alias("log_det"), *(["was"] if before else []))


def _consistency(share: float) -> float:
    """The factor that makes up for the share of the rows, the closest ones, that a covariance is taken of."""
    p = len(COORDINATES)
    return share / chi2_cdf(chi2_quantile(share, p), p + 2)


def _with_distance(rows: DataFrame, estimates: DataFrame, sized: Sized, of: str = "x", how: str = "left") -> DataFrame:
    """rows, once for each start of their group's estimates, with start and d2, the squared Mahalanobis distance, and `was`,
    if estimates have it; a group without estimates has nulls."""
    own = [c for c in rows.columns if c not in ("d2", "start", "was")]
    before = ["was"] if "was" in estimates.columns else []
    solved: list[Column] = []
    for i in range(len(COORDINATES)):
        rest = F.col(f"{of}{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * solved[k] for k in range(i)), F.lit(0.0))
        solved.append(rest / F.col(f"l{i}{i}"))
    return rows.select(*own).join(sized(estimates), "group", how).select(*own, "start", *before, sum((y * y for y in solved[1:]), solved[0] * solved[0]).alias("d2"))


def _closest(near: DataFrame, share: float, largest: int, sized: Sized, direct: bool = False) -> DataFrame:
    """Of each group and start, the given share of rows (rounded up) with the smallest distances, and those that tie with the
    last of them. The order statistic is exact: quantile sketches bracket it, once more for each GRID / 2 times that the
    largest group exceeds a bracket (not at all if `direct`), and in the last bracket rows are counted by distance. Rows that
    tie are one count: strictly between two quantiles lie no more distances than there are ranks, whatever ties."""
    bounds, left = None, largest
    while not direct and (bounds is None or left > BRACKET):
        if bounds is None:
            # The rank is the same share of each group here, so two quantiles around it do.
            edges = F.array(F.lit(max(share - 1 / GRID, 0.0)), F.lit(min(share + 1 / GRID, 1.0)))
            found = near.groupBy(*_KEYS).agg(F.percentile_approx("d2", edges, ACCURACY).alias("q"), F.count("*").alias("n"))
            bounds = found.select(*_KEYS, F.ceil(F.col("n") * share).alias("k"), F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))
        else:
            grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
            inside = F.col("d2").between(F.col("lo"), F.col("hi"))
            found = near.join(sized(bounds), _KEYS).groupBy(*_KEYS).agg(F.percentile_approx(F.when(inside, F.col("d2")), grid, ACCURACY).alias("q"), F.count_if(inside).alias("n"), F.first("k").alias("k"), F.count_if(F.col("d2") < F.col("lo")).alias("below"))
            at = F.floor((F.col("k") - F.col("below")) / F.col("n") * GRID).cast("int")
            bounds = found.select(*_KEYS, "k", F.when(at > 1, F.get("q", at - 1)).otherwise(-1.0).alias("lo"), F.coalesce(F.get("q", at + 2), F.lit(float("inf"))).alias("hi"))
        left = left * 4 // GRID
    last = _levels(near, bounds, share, sized)
    first = F.struct((F.col("k") - F.col("below")).alias("left"), F.lit(None).cast("double").alias("edge"))
    edge = F.aggregate("levels", first, lambda acc, x: F.when(acc["left"] > 0, F.struct((acc["left"] - x["n"]).alias("left"), x["v"].alias("edge"))).otherwise(acc), lambda acc: acc["edge"])
    return near.join(sized(last.select(*_KEYS, edge.alias("edge"))), _KEYS).where("d2 <= edge").drop("edge")


def _levels(near: DataFrame, bounds: DataFrame | None, share: float, sized: Sized) -> DataFrame:
    """For each group and start: k, the rank that is sought, `below`, how many rows lie below the bracket, and `levels`, the
    distances in it, each once, in order, with how many rows have it. Counts combine before the shuffle."""
    if bounds is None:
        counted = near.groupBy(*_KEYS, F.col("d2").alias("v")).agg(F.count("*").alias("n")).withColumns({"less": F.lit(False), "k": F.lit(None).cast("long")})
    else:
        v, less = F.when(F.col("d2").between(F.col("lo"), F.col("hi")), F.col("d2")), F.col("d2") < F.col("lo")
        counted = near.join(sized(bounds), _KEYS).groupBy(*_KEYS, v.alias("v"), less.alias("less")).agg(F.count("*").alias("n"), F.first("k").alias("k"))
    levels = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n"))))
    rank = F.coalesce(F.first("k"), F.ceil(F.sum("n") * share))
    return counted.groupBy(*_KEYS).agg(rank.alias("k"), F.coalesce(F.sum(F.when(F.col("less"), F.col("n"))), F.lit(0)).alias("below"), levels.alias("levels"))


def _starts(good: DataFrame, sized: Sized) -> DataFrame:
    """good with d2 by each of STARTS, deterministic ways to tell rows near a group's middle: deviations from the medians,
    scaled by median deviations, and distances by the covariances of these deviations' signs (their directions alone) and of
    their hyperbolic tangents, neither of which far rows can move much."""
    p = len(COORDINATES)
    own = [d for _, d in COORDINATES.values()]
    middle = good.groupBy("group").agg(*[F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"c{i}") for i in range(p)])
    centred = good.join(sized(middle), "group")
    spread = centred.groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, ACCURACY).alias(f"w{i}") for i in range(p)])
    scaled = [((F.col(f"x{i}") - F.col(f"c{i}")) / (1.4826 * F.col(f"w{i}") + own[i])).alias(f"z{i}") for i in range(p)]
    rows = centred.join(sized(spread), "group").select("group", *[f"x{i}" for i in range(p)], *scaled)
    squares = sum((F.col(f"z{i}") ** 2 for i in range(1, p)), F.col("z0") ** 2)
    bent = F.array(
        F.struct(F.lit(STARTS[1]).alias("start"), *[(F.col(f"z{i}") / F.sqrt(squares + 1e-12)).alias(f"x{i}") for i in range(p)]), F.struct(F.lit(STARTS[2]).alias("start"), *[F.tanh(f"z{i}").alias(f"x{i}") for i in range(p)])
    )
    first = _estimates(rows.select("group", F.inline(bent)), 1.0, [0.1] * p)
    others = _with_distance(rows, first.select(*_KEYS, *[F.lit(0.0).alias(f"m{i}") for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)]), sized, of="z")
    columns = ["group", *[f"x{i}" for i in range(p)], "start", "d2"]
    return rows.select(*columns[:-2], F.lit(STARTS[0]).alias("start"), squares.alias("d2")).union(others.select(*columns))


def _least_determinant(good: DataFrame, support: float, sized: Sized) -> DataFrame:
    """Of each group, the estimates of its support set: concentration from each start until no log-determinant changes, then
    the start with the least one."""
    largest, total = good.groupBy("group").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    own, scale, settled = [d for _, d in COORDINATES.values()], _consistency(support), []
    near = _starts(good, sized).withColumn("was", F.lit(None).cast("double"))
    for _ in range(MOST_STEPS):
        now = frozen(_estimates(_closest(near, support, largest, sized, total <= BRACKET), scale, own))  # a row for each group and start that moves
        still = F.coalesce(F.abs(F.col("log_det") - F.col("was")) > SETTLED, F.lit(True))
        settled.append(now.where(~still).drop("was"))
        moving = now.where(still).drop("was")
        if moving.isEmpty():
            break
        near = _with_distance(good, moving.withColumn("was", F.col("log_det")), sized, how="inner")
    else:
        settled.append(moving)
    every = reduce(DataFrame.union, settled)
    best = every.groupBy("group").agg(F.min_by(F.struct(*every.columns), F.struct(F.round("log_det", 8), "start")).alias("best"))
    return best.select("best.*")


def _grouped(rows: DataFrame, least: int, sized: Sized) -> DataFrame:
    """rows with their group: language and source, if these have enough good rows; otherwise all such small sources of the
    language together, or all such small languages; null if these are too few."""
    def counted(key: str) -> DataFrame:
        return rows.where("not base_failed").groupBy(key).agg(F.count("*").alias("_rows"))

    rows = rows.withColumn("group", F.to_json(F.array("lang", "source")))
    for broader in (F.to_json(F.array("lang")), F.lit("[]"), F.lit(None).cast("string")):
        small = F.coalesce(F.col("_rows"), F.lit(0)) < least
        rows = rows.join(sized(counted("group")), "group", "left").withColumn("group", F.when(small, broader).otherwise(F.col("group"))).drop("_rows")
    return rows


def outliers(rows: DataFrame, support: float = SUPPORT, tail: float = TAIL, least: int = LEAST_ROWS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """rows (with lang, source, base_failed and STATISTICS) with d2, their squared robust distance, and `outlier`.

    Minimum covariance determinant of the transformed statistics of each language and source: from several deterministic
    starts, each step takes mean and covariance of the closest `support` of the rows and finds the closest anew, until the
    support sets settle; the least determinant wins, and a last step re-weights by the 97.5 % point. Estimates are sums and
    sketches that combine before any shuffle, so a hot source costs no more than others. Rows that fail the base rules take
    no part in the estimates. Groups with under `least` rows are pooled; where even the pool is too small, nothing is an
    outlier. Rows that tie with a support set's last one belong to it; no rows give no rows.
    """
    p = len(COORDINATES)
    columns = [c for c in rows.columns if c not in ("d2", "outlier")]
    # A hot group would meet its rows of estimates in one task; sent to all tasks, they stay where the rows are.
    few = rows.select("lang", "source").distinct().count() <= broadcast_groups
    sized: Sized = F.broadcast if few else (lambda df: df)
    rows = _grouped(rows.select(*columns), least, sized).select(*columns, "group", *[f().alias(f"x{i}") for i, (f, _) in enumerate(COORDINATES.values())])
    rows = frozen(rows)
    good = rows.where("not base_failed and group is not null").select("group", *[f"x{i}" for i in range(p)])
    near = _with_distance(good, _least_determinant(good, support, sized), sized)
    estimates = frozen(_estimates(near.where(F.col("d2") <= chi2_quantile(0.975, p)), _consistency(0.975), [d for _, d in COORDINATES.values()]))
    found = _with_distance(rows, estimates, sized)
    return found.select(*columns, "d2", F.coalesce(F.col("d2") > chi2_quantile(1 - tail, p), F.lit(False)).alias("outlier"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, STATISTICS, base_failed, d2, outlier, kept) for each document. Null languages and sources are
    groups of their own; a column that is missing counts as null; repeated rows count each. No rows give no rows."""
    columns = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source", "text")]
    rows = with_statistics(docs.select("doc_id", *columns)).drop("text").withColumn("base_failed", base_failed())
    return outliers(frozen(rows)).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
