import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaestor.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, outlier string, d2 string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\nx\n x\nx\r\n\n", "#*$ %&|<> é🙂 \x0b\x0c\x1c\x85", "w " * 5000]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choices(["a", "b", "c\n", "#d", "é"], k=rng.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, None, None, "clash", "clash", "clash") for i, t in enumerate(texts)] + [(0, None, None, None, None, None, None), (None, "a", None, None, None, None, None)]
    got = quality.with_statistics(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in quality.STATISTICS) == plain(r.text), r.text


@pytest.mark.parametrize("freedom, p, want", [(1, 0.95, 3.841), (2, 0.95, 5.991), (5, 0.975, 12.833), (7, 0.5, 6.346)])
def test_chi2(freedom, p, want):
    assert abs(quality.chi2_quantile(p, freedom) - want) < 1e-3


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvw", k=rng.randint(2, 8))) for _ in range(n))


def fixture(rng):
    """Two large groups, one of which is hot, a small one, and junk among them."""
    rows, junk = [], set()
    for i in range(1300):
        lang, source = ("en", "hot") if i < 800 else ("de", "b") if i < 1200 else ("fr", f"s{i % 40}")
        text = sentence(rng, rng.randint(60, 300))
        if i % 13 == 0:
            text, _ = " ".join(w + "###$$" for w in text.split()), junk.add(i)
        rows.append((i, text, lang, source, None, None, None))
    return rows, junk


@pytest.mark.parametrize("groups", [50_000, 0])
def test_outliers_are_junk(spark, monkeypatch, groups):
    monkeypatch.setattr(quality.outliers, "__defaults__", (*quality.outliers.__defaults__[:-1], groups))
    rows, junk = fixture(random.Random(5))
    rows += [(5000, sentence(random.Random(1), 30), None, None, None, None, None), (5001, None, "en", "hot", None, None, None), (5002, sentence(random.Random(2), 80), "xx", None, None, None, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.kept} == junk | {5000, 5001}
    assert got[5002].kept and got[5000].base_failed and got[5001].base_failed


def estimate(x, keep, share):
    """(mean, covariance) as in _estimates."""
    own = np.array([d for _, d in quality.COORDINATES.values()])
    scale = share / quality.chi2_cdf(quality.chi2_quantile(share, 5), 7)
    return x[keep].mean(axis=0), np.cov(x[keep].T, bias=True) * scale + np.diag(own**2)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_distances_against_numpy(spark):
    """The distances follow from a support set that no concentration step changes, and none that numpy reaches from random
    subsets has a smaller determinant."""
    rows, _ = fixture(random.Random(6))
    judged = quality.judge(spark.createDataFrame(rows[:800], SCHEMA)).collect()
    ok = [r for r in judged if not r.base_failed]
    x = np.array([[np.log1p(r.n_words), np.log((r.word_chars + 1) / (r.n_words + 1)), r.n_symbols / (r.word_chars + 1), np.log1p(r.n_dup_lines), r.n_repeat_words / (r.n_words + 1)] for r in ok])
    h, rng, best = int(np.ceil(len(x) * quality.SUPPORT)), np.random.default_rng(1), None
    for _ in range(30):
        keep = rng.permutation(len(x))[: rng.choice([8, h])]
        for _ in range(100):
            mean, cov = estimate(x, keep, quality.SUPPORT)
            d2 = distances(x, mean, cov)
            keep = np.flatnonzero(d2 <= np.sort(d2)[h - 1])
        best = min(best or (np.inf, None), (np.linalg.slogdet(cov)[1], tuple(keep)))
    d2 = distances(x, *estimate(x, np.array(best[1]), quality.SUPPORT))
    d2 = distances(x, *estimate(x, d2 <= quality.chi2_quantile(0.975, 5), 0.975))
    assert np.allclose(d2, [r.d2 for r in ok], rtol=1e-6)


def test_least_determinant_against_all_subsets(spark):
    """On small groups: no subset of the support's size has a smaller determinant than the chosen one."""
    rng = np.random.default_rng(4)
    groups = {g: np.concatenate([rng.normal(0, [1, 0.2, 0.02, 0.5, 0.1], (9, 5)), rng.normal(6, 1, (3, 5))]) for g in "abc"}
    rows = [(g, *map(float, v)) for g, x in groups.items() for v in x]
    good = spark.createDataFrame(rows, "group string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {r.group: r.log_det for r in quality._least_determinant(good, 0.75, lambda df: df).collect()}
    for g, x in groups.items():
        want = min(np.linalg.slogdet(estimate(x, list(keep), 0.75)[1])[1] for keep in itertools.combinations(range(12), 9))
        assert got[g] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("bracket", [20_000, 40])
def test_closest_is_exact(spark, monkeypatch, bracket):
    """The order statistic, ties included, however often it is bracketed."""
    monkeypatch.setattr(quality, "BRACKET", bracket)
    rng = np.random.default_rng(2)
    d2 = {("a", "s"): rng.chisquare(5, 40_000), ("a", "t"): rng.integers(0, 5, 30_000).astype(float), ("b", "s"): rng.chisquare(5, 3), ("c", "s"): np.zeros(1)}
    rows = [(g, s, float(v)) for (g, s), x in d2.items() for v in x]
    near = spark.createDataFrame(rows, "group string, start string, d2 double").repartition(3)
    got = {(r.group, r.start): (r.n, r.top) for r in quality._closest(near, 0.75, 40_000, lambda df: df).groupBy("group", "start").agg(F.count("*").alias("n"), F.max("d2").alias("top")).collect()}
    for k, x in d2.items():
        edge = np.sort(x)[int(np.ceil(len(x) * 0.75)) - 1]
        assert got[k] == ((x <= edge).sum(), edge)


def test_ties_are_counted_and_not_gathered(spark, monkeypatch):
    """300,000 distances of which half are equal, at the rank that is sought or beside it: a bracket holds no more distances
    than its bound, and the edge is exact."""
    rng = np.random.default_rng(3)
    seen = []
    levels = quality._levels

    def watched(*given):
        made = levels(*given)
        seen.append(made.agg(F.max(F.size("levels"))).first()[0])
        return made

    monkeypatch.setattr(quality, "_levels", watched)
    x = np.concatenate([rng.chisquare(5, 150_000), np.full(150_000, 1.0)])
    y = np.concatenate([rng.chisquare(5, 150_000), np.full(150_000, 6.0)])
    near = spark.createDataFrame(pd.DataFrame({"group": ["a"] * 300_000 + ["b"] * 300_000, "start": "s", "d2": np.concatenate([x, y])})).repartition(4)
    for share in (0.5, 0.75):
        got = {r.group: (r.n, r.top) for r in quality._closest(near, share, 300_000, lambda df: df).groupBy("group").agg(F.count("*").alias("n"), F.max("d2").alias("top")).collect()}
        for k, v in (("a", x), ("b", y)):
            edge = np.sort(v)[int(np.ceil(len(v) * share)) - 1]
            assert got[k] == ((v <= edge).sum(), edge)
    assert max(seen) <= quality.BRACKET


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).collect() == []
