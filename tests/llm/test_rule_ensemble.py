import random

import numpy as np
from pyspark.sql import functions as F

from quaestor.llm import rules, trees
from quaestor.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, score string, label string"


def text_of(rng, good):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
    return " ".join(words if good else [w.upper() + rng.choice(["###", "!!", "$$"]) for w in words])


def test_read_tree():
    debug = """DecisionTreeRegressionModel: uid=x, depth=2, numNodes=5, numFeatures=3
  If (feature 0 <= 0.5)
   If (feature 2 <= -1.0E-4)
    Predict: -1.0
   Else (feature 2 > -1.0E-4)
    Predict: 0.25
  Else (feature 0 > 0.5)
   Predict: 1.0
"""
    tree = trees.read_tree(debug)
    assert tree == (0, 0.5, (2, -1e-4, -1.0, 0.25), 1.0)
    assert list(trees.paths(tree)) == [((0, 0.5, True),), ((0, 0.5, True), (2, -1e-4, True)), ((0, 0.5, True), (2, -1e-4, False)), ((0, 0.5, False),)]


def test_compiled_rules_against_plain_ones(spark):
    model = rules.RuleEnsemble(-0.3, [(1.5, (("words", 3.0, False),)), (-2.0, (("words", 10.0, True), ("digit_share", 0.1, False)))])
    texts = ["", "1 2 3 4", "a b c d e", "a1 " * 20, None]
    got = rules.with_variables(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)).withColumn("score", model.score()).collect()
    for r in got:
        total = -0.3 + (1.5 if r.words > 3 else 0) - (2.0 if r.words <= 10 and r.digit_share > 0.1 else 0)
        assert np.isclose(r.score, 1 / (1 + np.exp(-total)))


def test_held_out_rows(spark):
    rng = random.Random(7)
    good = {i: int(rng.random() < 0.7) for i in range(900)}
    rows = [(i, text_of(rng, g), "en", "clash", "clash") for i, g in good.items()]
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "word " * 60_000, None, None, None), (None, text_of(rng, 1), None, None, None), (0, rows[0][1], None, None, None)]
    labels = [(i, g) for i, g in good.items()] + [(1, good[1]), (2, None), (None, 1), (77_777, 1)]
    learn = F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True))
    got = rules.score_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), learn).withColumn("held_out", ~learn).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in good]
    assert len(held) > 200 and np.mean([(r.score >= 0.5) == good[r.doc_id] for r in held]) > 0.97


def test_one_label_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    always = F.lit(True)
    assert rules.score_quality(docs.limit(0), labels, always).collect() == []
    assert rules.score_quality(docs, labels.limit(0), always).first().score == 0.5
    assert rules.score_quality(docs, labels, always).first().score > 0.5
