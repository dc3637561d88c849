import random

import numpy as np
import pytest

from quaestor.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"
SYLLABLES = {"aa": ["tha", "ing", "er", "ou", "st"], "bb": ["ção", "lh", "ar", "os", "que"], "cc": ["sch", "ung", "ei", "ü", "tz"]}


def text_of(lang, rng, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, text_of(lang, rng), lang, "x", "x") for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(900, None, "aa", None, None), (901, "solo", "zz", None, None), (None, text_of("aa", rng), "aa", None, None), (902, "", "aa", None, None), (903, "text", None, None, None)]
    return langid.fit(spark.createDataFrame(rows, SCHEMA))


def test_scores_against_a_plain_sum(model, monkeypatch):
    """Slices and texts that share them don't change a score."""
    grams = langid.Grams()
    rng = random.Random(2)
    texts = ["", "é", "12 !", *(text_of(x, rng, n) for x in SYLLABLES for n in (1, 5, 900)), "A  b--C\n" * 500]
    alone = np.concatenate([model.score(grams, [t])[0] for t in texts])
    assert np.allclose(model.score(grams, texts)[0], alone, rtol=1e-4)
    symbols, _ = grams._symbols(["A--b"])
    assert symbols.tolist() == [0, ord("a"), 0, ord("b"), 0]
    monkeypatch.setattr(langid, "SLICE", 100)
    assert np.allclose(model.score(grams, texts)[0][:4], alone[:4], rtol=1e-4)
    best = [model.languages[i] for i in model.score(grams, texts)[0][3:12].argmax(axis=1)]
    assert best == [x for x in SYLLABLES for _ in range(3)]


def test_predictions(spark, model):
    assert model.languages == ["aa", "bb", "cc"]
    rng = random.Random(3)
    texts = [(lang, text_of(lang, rng, rng.randint(3, 60))) for lang in list(SYLLABLES) * 30]
    rows = [(i, t, None, "clash", "clash") for i, (_, t) in enumerate(texts)]
    rows += [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 + 3 !?", None, None, None), (None, "thaing ou", None, None, None), (1003, "tha " * 200_000, None, None, None), (0, rows[0][1], None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    right = [r.lang_pred == texts[r.doc_id][0] for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean(right) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "aa" and by[None].lang_pred == "aa"


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, model).collect() == []
    unlearned = langid.fit(none)
    (row,) = langid.identify(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA), unlearned).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_rare_languages_of_a_large_table(spark):
    """Beyond the bound, a rare language keeps its rows; priors are of the whole table."""
    rng = random.Random(4)
    rows = [(i, text_of("aa", rng, 5), "aa", None, None) for i in range(3000)] + [(5000 + i, text_of("bb", rng, 5), "bb", None, None) for i in range(12)]
    model = langid.fit(spark.createDataFrame([*rows, (9000, "solo", "zz", None, None)], SCHEMA), rows=200)
    assert model.languages == ["aa", "bb"] and np.allclose(np.exp(model.prior), [3000 / 3012, 12 / 3012])
    texts = [(i, text_of("bb", rng), None, None, None) for i in range(20)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(texts, SCHEMA), model).collect()} == {"bb"}
