import random
from itertools import product

import numpy as np
import pytest

from quaestor.llm import crf

SCHEMA = "doc_id long, text string, label int, score string, spans string"
CLEAN = ["alpha", "beta", "gamma", "delta", "and", "the", "of", "naïve", "straße"]
INSULTS = ["idiot", "scum", "réeuxment", "réeuxoi", "réeuxaux"]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    lengths = [3, 0, 1, 5, 2]
    first = np.concatenate(([0], np.cumsum(lengths)))
    potentials, transitions = rng.normal(size=first[-1]) * 2, rng.normal(size=(2, 2))
    p, pair = crf.marginals(potentials, first, transitions)
    for t, n in enumerate(lengths):
        if not n:
            continue
        own = potentials[first[t] : first[t + 1]]
        total, toxic, steps = 0.0, np.zeros(n), np.zeros((n, 4))
        for states in product((0, 1), repeat=n):
            w = np.exp(sum(own[i] * s for i, s in enumerate(states)) + sum(transitions[a, b] for a, b in zip((0, *states), (*states, 0))))
            total += w
            toxic += w * np.array(states)
            for i in range(1, n):
                steps[i, 2 * states[i - 1] + states[i]] += w
        assert np.allclose(p[first[t] : first[t + 1]], toxic / total)
        assert np.allclose(pair[first[t] : first[t + 1]], steps / total)


def test_long_sequences_stay_finite():
    p, _ = crf.marginals(np.tile([30.0, -30.0], 20_000), np.array([0, 40_000]), np.array([[1.0, -9.0], [-9.0, 1.0]]))
    assert np.isfinite(p).all()


def test_logistic():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(4000), rng.normal(size=(4000, 2))])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [-1, 2, -0.5])))).astype(float)
    assert np.allclose(crf.fit_logistic(x, y), [-1, 2, -0.5], atol=0.2)


def rows_of(rng, n, at=0):
    rows = []
    for i in range(n):
        words, toxic = rng.choices(CLEAN + [f"w{rng.random()}"], k=rng.randint(5, 120)), int(rng.random() < 0.3)
        if toxic:
            for w in rng.choices(INSULTS, k=rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        rows.append((at + i, rng.choice([" ", "  ", ", "]).join(words), toxic, None, None))
    return rows


def fitted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return crf.fit(df, df)


@pytest.fixture(scope="module")
def model(spark):
    rows = rows_of(random.Random(3), 600) + [(9000, None, 0, None, None), (9001, "", 0, None, None), (9002, "alpha", None, None, None)]
    return fitted(spark, rows)


def test_held_out_rows_and_spans(spark, model, monkeypatch):
    monkeypatch.setattr(crf, "SLICE", 2000)
    rows = rows_of(random.Random(4), 300, 10_000)
    rows += [(1, None, None, "clash", "clash"), (2, "", None, None, None), (3, "…", None, None, None), (4, "alpha " * 50_000 + "idiot scum", None, None, None), (None, "you idiot", None, None, None), (10_000, rows[0][1], None, None, None)]
    rows += [(5, "ñé IDIOT Scum, ok réeuxelle.", None, None, None)]
    got = crf.score_toxicity(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    label = {r[0]: r[2] for r in rows if r[2] is not None}
    right = [(r.score >= 0.5) == label[r.doc_id] for r in got if r.doc_id in label]
    assert np.mean(right) > 0.97
    by, text = {r.doc_id: r for r in got}, {r[0]: r[1] for r in rows}
    assert by[1].score == by[2].score < 0.1 and by[3].score < 0.1 and by[1].spans == []
    assert [text[4][s.start : s.end] for s in by[4].spans] == ["idiot scum"]
    assert " ".join(text[5][s.start : s.end] for s in by[5].spans).split()[0] == "IDIOT"
    for r in got:
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(text[r.doc_id]) and s.p >= crf.TOXIC


def test_one_label_and_empty_tables(spark, model):
    none = spark.createDataFrame([], SCHEMA)
    assert crf.score_toxicity(none, model).collect() == []
    for rows, want in (([], 0.5), ([(i, "alpha", 0, None, None) for i in range(8)], 0.1)):
        flat = fitted(spark, rows)
        (r,) = crf.score_toxicity(spark.createDataFrame([(1, "idiot", None, None, None)], SCHEMA), flat).collect()
        assert r.score == pytest.approx(want) and r.spans == []


def test_all_rows_below_the_bound_give_weights(spark):
    """1,000 rows of each label are within the bound, so each word of the lexicon is seen by the field, rare ones too."""
    rng, rows = random.Random(6), []
    rare = [f"{rng.getrandbits(48):012x}" for _ in range(300)]
    for i in range(2000):
        words = rng.choices(CLEAN, k=12)
        if i % 2:
            words.insert(rng.randrange(12), rare[i // 2 % 300])
        rows.append((i, " ".join(words), i % 2, None, None))
    model = fitted(spark, rows)
    assert len(model.words) > 300 and (model.emissions[0, 1:] != 0).all()


def test_fit_converges(spark):
    """At the end the gradient is gone, and other starts lead to the same marginals; the steps stay below their bound."""
    rng, kinds = np.random.default_rng(3), len(crf.STARTS)
    # Each kind of feature has its own 30 weights; the first kind tells the label, the others are noise.
    ids = (rng.integers(1, 31, (kinds, 4000)) + 30 * np.arange(kinds)[:, None]).astype(np.int32)
    toxic, first = (np.isin(ids[0], [3, 4, 5]) ^ (rng.random(4000) < 0.05)).astype(float), np.arange(0, 4001, 40)
    made = []
    for start in (0.0, 0.7):
        model = crf.ToxicityModel(words=np.arange(30 * kinds, dtype=np.uint64), emissions=np.full((3, 30 * kinds + 1), start))
        model.emissions[:, 0] = 0
        steps = crf.fit_field(model, ids, toxic, first)
        assert steps < crf.MOST_STEPS
        made.append(crf.marginals(model.potentials(ids, first), first, model.transitions)[0])
    assert np.abs(made[0] - made[1]).max() < 0.02 and made[0][toxic == 1].mean() > made[0][toxic == 0].mean() + 0.5


def test_rare_toxic_rows(spark):
    """Labels are sampled each for itself: 40 toxic rows of 8,000 give weights though the bound is 400 rows."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(CLEAN, k=20) + (["scum"] if i % 200 == 0 else [])), int(i % 200 == 0), None, None) for i in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = crf.fit(df, df, lexicon_rows=400, field_rows=100)
    assert len(model.words)
    got = {r.doc_id: r.score for r in crf.score_toxicity(spark.createDataFrame(rows[:400], SCHEMA), model).collect()}
    assert min(got[i] for i in (0, 200)) > max(v for i, v in got.items() if i % 200)
