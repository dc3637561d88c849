"""The pipeline's stages, each against a plain version of its own work on its own input."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_decontam import plain as plain_contamination
from test_pii import plain as plain_spans
from tokenizers import Tokenizer

from quaestor.llm import langid, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each: [rows by stage]."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "12 34 !!", "en", "src0", 8), (None, "the and that with of in to", "en", "src0", 26)], docs.schema)
    docs, out = docs.union(extra), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs.columns, docs.collect()))
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return [*out, (docs.columns, docs.collect())]


def plain_shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c, _ in stages[:5])


def test_language_id(spark, stages):
    before, after = stages[0][1], by_id(stages[1][1])
    assert {r.doc_id for r in before} - set(after) >= {900_001, 900_002}
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    from quaestor.llm.common import crc_mod

    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    letters = [r for r in before if any(c.isalpha() for c in r.text or "")]
    total, n = model.score(langid.Grams(), [r.text for r in letters])
    odds = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(n)[:, None])
    want = {r.doc_id: model.languages[k] for r, k, s in zip(letters, total.argmax(axis=1), 1 / odds.sum(axis=1)) if s >= 0.5}
    assert {i: r.lang for i, r in after.items()} == want


def test_near_duplicates(stages):
    before, after = stages[1][1], stages[2][1]
    """One row of each component of documents that share five-word shingles at a Jaccard similarity of 0.8 or more."""
    rows = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [frozenset(plain_shingles(r.text)) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(str(r.doc_id) for r in after) == sorted(str(rows[i].doc_id) for i in range(len(rows)) if find(i) == i)


def test_links_of_both_kinds(spark):
    """Operator 5's links count, though five-word shingles differ: texts that repeat a sentence and end differently. So do
    links that its fingerprints miss, and chains of both."""
    tail = lambda t, n=40: " ".join(f"{t}{k}" for k in range(n))
    same = "one two three four five six seven " * 200
    words = [f"w{k}" for k in range(400)]
    near = [("x" if k % 50 == 7 else w) for k, w in enumerate(words)]  # 8 words of 400
    rows = [(1, same + tail("a")), (2, same + tail("b")), (3, tail("c", 400)), (4, " ".join(words)), (5, " ".join(near)), (6, same + tail("b") + " z"), (7, tail("a")), (8, tail("b"))]
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert (prints[1] ^ prints[2]).bit_count() <= simhash.RADIUS < (prints[4] ^ prints[5]).bit_count()
    a, b = (set(plain_shingles(rows[k][1])) for k in (0, 1))
    assert 10 * len(a & b) < 8 * len(a | b)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 8]


def test_decontamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = stages[2][1], stages[3][1]
    clean = {r.doc_id: r.text for r in before if not plain_contamination(r.text, items)[1]}
    assert {r.doc_id: r.text for r in after} == clean and len(clean) > 0.8 * len(before)


def test_personal_data(stages):
    """All documents stay; no base span is left, and documents without any, or without what is like one, are untouched."""
    before, after = by_id(stages[3][1]), by_id(stages[4][1])
    assert set(before) == set(after)
    changed = {i for i in before if before[i].text != after[i].text}
    assert {i for i, r in before.items() if plain_spans(r.text)} <= changed
    assert not any(plain_spans(r.text) for r in after.values()) and all(r.n_chars == len(r.text) for r in after.values())
    assert all(plain_spans(before[i].text) or "token" in before[i].text for i in changed)


def test_packing(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in stages[5][1]:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: sum((p for _, p in sorted(own)), []) for i, own in pieces.items()} == {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in stages[4][1]}


CLASHES = ("row", "rest", "id", "point", "items", "key", "score", "base", "spans", "lang_pred", "redacted", "n_words", "contaminated", "component_id", "label", "_t", "_more")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, name):
    """Extra columns with any name come back as they were; nulls in any column, repeated rows and empty tables pass."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", None, None), (7, "the same words of that text", "en", None, 1), (7, "the same words of that text", "en", None, 1)], docs.schema)
    docs = docs.union(odd)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    wide = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    got, want = stage(spark, wide, SF), stage(spark, docs, SF)
    if name == "packing":
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert stage(spark, docs.limit(0), SF).collect() == []
        return
    assert got.columns == wide.columns and want.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == (None if r.doc_id is None else f"{c} {r.doc_id}") for r in rows for c in CLASHES)
    assert sorted(str([r[c] for c in docs.columns]) for r in rows) == sorted(str([r[c] for c in docs.columns]) for r in want.collect())
    assert stage(spark, wide.limit(0), SF).collect() == []
