import random
import re
import time

import pytest

from quaestor.llm import decontam

SCHEMA = "doc_id long, text string, item string, n_hit long, key string, n_words string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        other = words(body)
        n = min(10, len(other))
        grams = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else set()
        for i in range(len(own) - n + 1) if n else ():
            if tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


def fixture():
    rng = random.Random(3)
    vocabulary = ["a", "b", "cc", "É", "straße", "ж9"]
    some = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(some(n))) for i, n in enumerate((0, 1, 2, 4, 5, 7, 9, 10, 11, 25, 60))]
    items += [(10, items[10][1]), (77, items[9][1]), (78, None), (None, "a b cc a b cc a b cc a b cc"), (79, "a " * 30)]
    texts = [None, "", "...", "A", "a-b.CC", "a " * 3000, items[10][1].upper().replace("ß".upper() * 2, "ß")]
    for _ in range(40):
        own = some(rng.randint(1, 80))
        body = words(rng.choice([b for _, b in items if b]) or "a")
        at = rng.randrange(len(body)) if body else 0
        own[rng.randrange(len(own)) : 0] = body[at : at + rng.randint(8, 30)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(own))
    return items, texts


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_against_plain_search(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 500)
    items, texts = fixture()
    rows = [(i, t, "clash", 1, "clash", "clash") for i, t in enumerate(texts)] + [(2, texts[2], None, None, None, None), (None, texts[8], None, None, None, None)]
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, broadcast_bytes=limit, keep=("key", "text")).collect()
    assert len(got) == len(rows)
    good = [(i, b) for i, b in items if i is not None]
    for r in got:
        n, hit, found = plain(texts[8 if r.doc_id is None else r.doc_id], good)
        assert r.text == texts[8 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (n, hit, found, hit > 0)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_many_items_share_a_sentence(spark, limit):
    """20,000 items with one sentence, and a document that repeats it 1,000 times: the windows are looked up once, not item by
    item (a product would take minutes)."""
    sentence = "choose the best answer to the question below and explain why"
    rng = random.Random(1)
    items = [(i, f"{sentence} {rng.randrange(10**9)} {i}") for i in range(20_000)]
    docs = [(1, f"{sentence}. " * 1000), (2, items[7][1]), (3, "nothing of it here"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    made = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_bytes=limit)
    start = time.time()
    got = {r.doc_id: r for r in made.collect()}
    assert time.time() - start < 60
    every = sorted(str(i) for i, _ in items)
    assert got[1]["items"] == every and got[1].n_hit == got[1].n_words == 11_000
    assert got[2]["items"] == every and got[2].n_hit == 13
    assert [(got[i].n_hit, got[i]["items"]) for i in (3, 4)] == [(0, []), (0, [])]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_empty_tables(spark, limit):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(docs.limit(0), bench, broadcast_bytes=limit).collect() == []
    (row,) = decontam.contamination(docs, bench.limit(0), broadcast_bytes=limit).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])
